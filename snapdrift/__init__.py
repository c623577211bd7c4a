"""Change detection over repeatedly captured documents, as Spark jobs."""
