"""Extraction of page streams."""
