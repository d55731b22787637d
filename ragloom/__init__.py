"""ragloom: a PySpark-native engine for retrieval-augmented-generation data."""
