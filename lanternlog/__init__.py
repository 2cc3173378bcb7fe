"""A PySpark-native engine for offline security-event analysis."""
