"""Spark-first analytics for position-level genomic tables and large text corpora."""
