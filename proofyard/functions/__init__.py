"""Operators over log tables."""
