"""Operators for large training corpora: text and vectors."""
