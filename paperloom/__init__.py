"""paperloom: Spark-native analytics for large collections of scanned historical text."""
