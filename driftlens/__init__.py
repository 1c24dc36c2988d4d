"""A PySpark-native engine for longitudinal disclosure tracking."""
