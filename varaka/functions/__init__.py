"""Functions of the reference workloads."""
