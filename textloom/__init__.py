"""textloom: Spark-native operators for building and checking training corpora."""
