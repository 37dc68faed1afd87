"""Contract-document analytics expressed as Spark DataFrame jobs."""
