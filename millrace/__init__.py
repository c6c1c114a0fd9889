"""Spark-native building blocks for text and image-language corpora."""
