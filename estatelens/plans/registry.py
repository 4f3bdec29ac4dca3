"""Registered queries: a Spark plan over the given tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)
_REAL = (T.FloatType, T.DoubleType)


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers as BIGINT, reals to six digits, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _WHOLE):
            c = c.cast("bigint")
        elif isinstance(f.dataType, _REAL):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register `plan(spark, folder)`; `oracle` may use the named derived views."""
    def register(plan):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(plan(spark, folder))
        run.__name__, run.__doc__ = name, plan.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views) if views else oracle.strip()
        return plan
    return register


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lit_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"
