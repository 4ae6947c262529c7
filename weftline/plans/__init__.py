"""Registered queries."""

from . import crawl, more, queries  # noqa: F401  the others add their own to those of queries
