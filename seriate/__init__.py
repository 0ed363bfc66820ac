"""A PySpark-native engine for library serials holdings."""
