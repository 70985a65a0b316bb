"""torquelake: a Spark-native analytics engine for vehicle-diagnostic data."""
