"""stripelake: a Spark-native columnar analytics engine."""
