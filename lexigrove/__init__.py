"""Text indexing, ranked retrieval and corpus preparation as Spark DataFrame plans."""
