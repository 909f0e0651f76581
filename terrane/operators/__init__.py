"""Relational operators over code-model tables."""
