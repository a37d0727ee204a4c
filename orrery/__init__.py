"""Orrery: a PySpark-native analytics engine for directed edge lists and text corpora."""
