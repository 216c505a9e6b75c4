"""Relational operators on edge lists and label maps."""
