"""Spindrift: a PySpark-native analytics engine for orbital catalogues."""
