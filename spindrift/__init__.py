"""Spark-native analytics over digitised documents: pages, lines, reviews, votes, vectors."""
