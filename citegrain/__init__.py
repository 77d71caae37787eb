"""Answer-provenance and retrieval analytics on Spark."""
