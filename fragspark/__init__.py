"""Fragment interval analytics on Spark."""
