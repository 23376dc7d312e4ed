"""Streaming of the sales analytics library."""
