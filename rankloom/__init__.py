"""A PySpark-native engine for hybrid candidate retrieval and its evaluation."""
