"""Cell-traceable analytics on Spark: every number links to the cells it came from."""
