"""Spark-native network-flow and DNS analytics: DataFrame in, DataFrame out."""
