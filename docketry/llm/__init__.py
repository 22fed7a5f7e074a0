"""Training-data operators for very large text corpora, written as Spark jobs."""
