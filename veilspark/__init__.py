"""PySpark-native pseudonymization and training-data engine."""
