"""keelson: a PySpark-native engine for keyed relational tables."""
