"""cairn: a Spark-native analytics engine for a review-gated knowledge graph."""
