"""Operators over layer tables."""
