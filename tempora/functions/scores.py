"""Scores of a rule's candidate: pluggable, as functions from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(rule_supp: Column, body_supp: Column, smoothing: float = 0.0) -> Column:
    return rule_supp / (body_supp + smoothing)


def recency(start: Column, now: Column, lmbda: Column | float) -> Column:
    """exp(lambda * (latest start of a matching walk - query time))."""
    return F.exp(lmbda * (start - now))


def combined(rule_supp: Column, body_supp: Column, start: Column, now: Column, lmbda: Column | float = 0.1, a: Column | float = 0.5) -> Column:
    return a * confidence(rule_supp, body_supp) + (1 - a) * recency(start, now, lmbda)


def noisy_or(score: Column) -> Column:
    """An aggregate: 1 - prod(1 - score)."""
    return 1 - F.product(1 - score)
