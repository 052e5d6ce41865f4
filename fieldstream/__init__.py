"""Batch and streaming analytics for field monitoring, and operators for text corpora, on Spark."""
