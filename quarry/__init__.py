"""Code-intelligence analytics on Spark."""
