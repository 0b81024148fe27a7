"""Spark-native engine for knowledge retrieval: ingest, index, search, reporting and dataflow as DataFrame plans."""
