"""PySpark-native product search, retrieval evaluation and retrieval-data curation."""
