"""Operators on the files, lines, findings and responses tables."""
