"""Registered queries by topic."""

from pathmere.plans import expressions, maintenance, searching, summaries  # noqa: F401
from pathmere.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["search_ranked"](spark, sf_dir)
