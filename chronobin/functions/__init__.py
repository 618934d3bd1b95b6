"""Scalar functions over event columns, and bit arrays."""
