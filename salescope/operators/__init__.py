"""Operators of the sales analytics library."""
