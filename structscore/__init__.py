"""Spark-native scoring of structured extractions, with reports over the scores."""
