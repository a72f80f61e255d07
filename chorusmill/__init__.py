"""chorusmill: a PySpark-native engine for comment corpora and training-data tables."""
