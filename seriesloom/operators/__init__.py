"""Relational operators over observations and panels."""
