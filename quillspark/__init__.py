"""A Spark-native engine for timed transcripts: cleaning, chunking, indexing, retrieval and evaluation."""
