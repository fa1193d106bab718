"""Spark-native preparation and evaluation of speech and text corpora."""
