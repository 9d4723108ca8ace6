"""Relational operators on the domain tables."""
