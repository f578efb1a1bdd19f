"""Road-flow analytics on Spark."""
