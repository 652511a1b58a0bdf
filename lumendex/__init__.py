"""PySpark-native documentation search and analytics."""
