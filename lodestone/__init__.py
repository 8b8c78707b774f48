"""Lodestone: a Spark-native engine for evidence graphs and corpus preparation."""
