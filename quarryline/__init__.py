"""quarryline: a PySpark-native text-analytics and entity-resolution engine."""
