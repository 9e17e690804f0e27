"""Bar-series analytics on Spark."""
