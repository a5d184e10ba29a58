"""Spark-native graph analytics, resilience analysis and corpus preparation."""
