"""A PySpark-native engine for building, auditing and measuring text and speech corpora."""
