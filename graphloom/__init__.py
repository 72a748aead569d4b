"""Spark-native knowledge-graph and text analytics."""
