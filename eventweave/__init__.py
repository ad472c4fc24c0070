"""Event analytics on Spark."""
