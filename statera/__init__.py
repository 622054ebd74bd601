"""Statera: Spark-first analytics over disclosure records and large text corpora."""
