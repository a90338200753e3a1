"""Document question answering as Spark batch and stream jobs."""
