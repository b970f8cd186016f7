"""A PySpark-native retrieval and text-analytics engine."""
