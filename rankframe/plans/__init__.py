"""Registered queries: operators bound to the test tables, and the SQL that states the same results."""

from __future__ import annotations

from . import composites, corpus, extensions, search
from .base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """Exact cosine top-k, then nDCG@10 and reciprocal rank per query."""
    return search.scored(spark, sf_dir)


__all__ = ["composites", "corpus", "extensions", "flagship", "oracles", "queries", "search"]
