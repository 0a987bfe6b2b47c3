"""tidewick: a PySpark-native engine for bar formulas, statistical gates and monitoring."""
