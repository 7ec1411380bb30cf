"""obsgrain: a PySpark-native engine for observation tables and for text corpora."""
