"""Spark-native analytics over trees of source files and tables of text."""
