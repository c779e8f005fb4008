"""A Spark-native engine for session knowledge: claims, graphs, retrieval and context packing."""
