"""Sources of the reference workloads."""
