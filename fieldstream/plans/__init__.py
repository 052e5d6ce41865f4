"""Registered queries and their SQL."""

from . import layers, models, reports, stored, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "layers", "models", "reports", "stored", "streams"]
