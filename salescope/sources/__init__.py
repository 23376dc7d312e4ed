"""Sources of the sales analytics library."""
