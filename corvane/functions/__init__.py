"""Scalar functions and the address grammar, as column expressions."""
