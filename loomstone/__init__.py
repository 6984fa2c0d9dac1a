"""Spark-native document analytics: retrieval, facts, topics, reconciliation, reports."""
