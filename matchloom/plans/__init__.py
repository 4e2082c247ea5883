"""Whole plans: the end-to-end run, and the registered queries with their SQL."""
