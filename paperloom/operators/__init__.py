"""Relational operators on document tables."""
