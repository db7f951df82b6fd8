"""Folio: a PySpark-native analytics engine for parsed documents."""
