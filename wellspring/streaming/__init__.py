"""Screens as they arrive: plates as micro-batches."""
