"""Functions of the sales analytics library."""
