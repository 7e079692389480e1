"""A PySpark-native engine for multi-way join analytics."""
