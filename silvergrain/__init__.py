"""silvergrain: photo-archive analytics written as Spark DataFrame jobs."""
