"""Gleanwork: a Spark-native engine for curating collections of web content."""
