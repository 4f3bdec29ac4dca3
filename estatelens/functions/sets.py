"""Similarities of small per-row sets (arrays); all stay inside one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.text import as_col

DIGITS = 9


def overlap(a, b) -> Column:
    return F.size(F.array_intersect(as_col(a), as_col(b)))


def either(a, b) -> Column:
    return F.size(F.array_union(as_col(a), as_col(b)))


def jaccard(a, b) -> Column:
    """Shared over all; 0 when both are empty."""
    n = either(a, b)
    return F.when(n > 0, overlap(a, b) / n).otherwise(F.lit(0.0))


def at_least(score, threshold: float) -> Column:
    """Threshold test on the score rounded to nine digits."""
    return F.round(as_col(score), DIGITS) >= F.lit(float(threshold))


def set_key(*arrays) -> Column:
    """Stable key of several sorted arrays."""
    return F.md5(F.concat_ws("\u0002", *[F.concat_ws("\u0001", as_col(a)) for a in arrays]))


def name_tokens(name) -> Column:
    """Distinct `_` tokens of a name in lower case."""
    return F.array_distinct(F.split(F.lower(as_col(name)), "_"))


def name_similarity(a, b, a_tokens=None, b_tokens=None) -> Column:
    """1 when equal, 0.8 when one contains the other, else Jaccard of the `_` tokens.

    Where rows are paired, take the tokens (`name_tokens`) of either side before.
    """
    x, y = F.lower(as_col(a)), F.lower(as_col(b))
    left = name_tokens(a) if a_tokens is None else as_col(a_tokens)
    right = name_tokens(b) if b_tokens is None else as_col(b_tokens)
    shared = overlap(left, right)
    n = F.size(left) + F.size(right) - shared  # tokens are distinct
    return (
        F.when(x == y, 1.0)
        .when(x.contains(y) | y.contains(x), 0.8)
        .otherwise(F.when(n > 0, shared / n).otherwise(F.lit(0.0)))
    )


def keyword_similarity(a, b) -> Column:
    """Jaccard of keyword sets; 0.5 when both are empty, 0 when one is."""
    x, y = as_col(a), as_col(b)
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), 0.5)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(jaccard(x, y))
    )


def count_map_similarity(a, b) -> Column:
    """Mean over all keys of 1 - |x-y| / max(x, y, 1) for two maps of counts."""
    x, y = as_col(a), as_col(b)
    keys = F.array_union(F.map_keys(x), F.map_keys(y))

    def closeness(k):
        p = F.coalesce(F.try_element_at(x, k), F.lit(0)).cast("double")
        q = F.coalesce(F.try_element_at(y, k), F.lit(0)).cast("double")
        return 1 - F.abs(p - q) / F.greatest(p, q, F.lit(1.0))

    total = F.aggregate(F.transform(keys, closeness), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(total / F.size(keys))
