"""Corpus retrieval and log analytics expressed as Spark DataFrame jobs."""
