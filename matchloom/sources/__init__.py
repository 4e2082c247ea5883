"""Readers, writers and the tables between steps."""
