"""gridleaf: Spark-native analytics over table-heavy documents."""
