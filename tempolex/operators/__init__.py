"""Relational operators over versioned text."""
