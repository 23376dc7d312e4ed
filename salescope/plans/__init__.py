"""Plans of the sales analytics library."""
