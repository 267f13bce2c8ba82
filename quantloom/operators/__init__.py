"""Relational operators over price panels."""
