"""Spark-native curation, search and evaluation of change-record corpora."""
