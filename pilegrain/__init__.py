"""Spark-native grouping, sampling and review analytics over photo, face and document tables."""
