"""treesift: a Spark-native file-metadata search and analytics engine."""
