"""A PySpark-native engine for satellite image time series."""
