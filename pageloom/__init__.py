"""Page analytics on Spark: captured web pages in, relational records out."""
