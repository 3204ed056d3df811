"""A Spark-native engine for hybrid retrieval and corpus analytics."""
