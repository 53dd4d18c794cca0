"""Relational and statistical operators over object tables."""
