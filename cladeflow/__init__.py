"""Hierarchical classification analytics as Spark DataFrame operators."""
