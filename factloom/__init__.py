"""A PySpark-native analytics engine for evidence-bearing records."""
