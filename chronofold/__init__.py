"""Web-history analytics on Spark."""
