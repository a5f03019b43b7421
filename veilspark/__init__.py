"""veilspark: a PySpark-native engine for stream anonymization and training-data preparation."""
