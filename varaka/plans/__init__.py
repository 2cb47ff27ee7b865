"""Plans of the reference workloads."""
