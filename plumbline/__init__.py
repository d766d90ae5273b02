"""A Spark-native quality engine for large field-survey tables."""
