"""Document retrieval, revision alignment and timeline analytics as Spark DataFrame pipelines."""
