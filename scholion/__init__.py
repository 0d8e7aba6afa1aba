"""Passage, entity and relationship analytics as Spark DataFrame operators."""
