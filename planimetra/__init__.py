"""Spatial measurement analytics as Spark DataFrame operators."""
