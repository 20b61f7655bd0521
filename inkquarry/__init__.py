"""Inkquarry: a PySpark-native engine for turning scientific documents into queryable numeric data."""
