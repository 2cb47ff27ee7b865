"""Operators of the reference workloads."""
