"""Turnlake: a PySpark-native analytics engine for time-segmented speech data."""
