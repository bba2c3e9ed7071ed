"""tidemark: publisher operations analytics as lazy Spark DataFrame jobs."""
