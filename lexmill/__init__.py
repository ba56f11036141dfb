"""lexmill: selection, deduplication and analytics over versioned text corpora, on Apache Spark."""
