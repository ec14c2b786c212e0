"""Habitat-capacity analytics as composable Spark DataFrame operators."""
