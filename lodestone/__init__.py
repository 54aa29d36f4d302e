"""Lodestone: a Spark-first engine for preparing and measuring text corpora."""
