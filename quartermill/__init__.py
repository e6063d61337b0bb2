"""A PySpark-native engine for analytics over quarterly portfolio disclosures."""
