"""Readers, writers and test-table projections."""
