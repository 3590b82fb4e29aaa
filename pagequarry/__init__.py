"""Product extraction from raw web pages as Spark DataFrame jobs."""
