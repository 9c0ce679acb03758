"""postlake: a PySpark-native engine for mail archives and text corpora."""
