"""Structured Streaming forms of the folds and recurrences."""
