"""Spark-first code search, navigation and corpus analytics."""
