"""Spark-first analytics over document and source-code corpora."""
