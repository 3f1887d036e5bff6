"""Relational operators over documents, fields, issues, keys and state."""
