"""A Spark-native engine for large sparse count matrices and the graphs derived from them."""
