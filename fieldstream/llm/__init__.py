"""Operators for building training corpora from text, page and vector tables."""
