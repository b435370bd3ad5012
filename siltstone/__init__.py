"""siltstone: a PySpark-native document-ingestion and vector-search engine."""
