"""A PySpark-native analytics engine for panels of time series keyed by instrument."""
