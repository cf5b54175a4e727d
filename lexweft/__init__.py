"""lexweft: a PySpark-native entity-linking and text-analytics engine."""
