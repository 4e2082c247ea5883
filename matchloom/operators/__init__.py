"""Operators on DataFrames: candidates, context, features, decisions, evaluation."""
