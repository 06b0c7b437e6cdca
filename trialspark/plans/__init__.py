"""Queries bound to the test tables, and their SQL."""

from trialspark.plans import around, decoding, lookups, pulse_lines, signal, summaries, sweeps, tuned  # noqa: F401
from trialspark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
