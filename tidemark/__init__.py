"""Ownership-disclosure analytics as Spark DataFrame transformations."""
