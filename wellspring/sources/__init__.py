"""Readers and writers: tables, layouts, panels, plates."""
