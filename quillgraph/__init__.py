"""A PySpark-native analytics engine for document corpora and knowledge graphs."""
