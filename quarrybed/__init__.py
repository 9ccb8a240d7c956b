"""A PySpark-native engine for program-artifact data and training corpora."""
