"""School and exam analytics expressed as Spark DataFrame jobs."""
