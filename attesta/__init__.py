"""Evidence analysis over documents, as Spark jobs."""
