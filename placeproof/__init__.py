"""Evidence scoring and entity resolution for place photos, as Spark DataFrame jobs."""
