"""A Spark-native engine for versioned documents: authority, retrieval and evidence analytics."""
