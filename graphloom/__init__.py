"""Spark-native graph analytics: traversal, decomposition and (incremental) betweenness."""
