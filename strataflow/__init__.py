"""strataflow: Spark-native operators for partitioned, ordered sensor series."""
