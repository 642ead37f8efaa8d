"""Spark-native detection, scoring and protection of personal data, and the analytics around it."""
