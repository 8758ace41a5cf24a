"""Tarn: a Spark-native retrieval engine for source code and other text corpora."""
