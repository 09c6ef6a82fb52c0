"""Scans of the file formats the engine reads."""
