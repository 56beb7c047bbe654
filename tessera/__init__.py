"""Tessera: a PySpark-native engine for document knowledge: parsing, tagging,
normalising, indexing, hybrid retrieval, evaluation and operational reporting."""
