"""Spark-first analytics with fresh reads over mutable tables."""
