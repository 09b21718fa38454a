"""tidemark: Spark-native operators for daily-bar market research."""
