"""Arrays of regex matches with their groups and line numbers, one text scan per pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import as_col, find_all, newlines


def group(match, pattern: str, n: int) -> Column:
    return F.regexp_extract(match, pattern, n)


def matches(text, pattern: str) -> Column:
    """Whole matches, in order."""
    return find_all(text, pattern, 0)


def matches_with_lines(text, pattern: str) -> Column:
    """Array of (text, line): the line is counted from the pieces between the matches."""
    text = as_col(text)
    found = matches(text, pattern)
    between = F.transform(F.split(text, pattern), newlines)
    inside = F.transform(found, newlines)

    def add(values):
        return F.aggregate(values, F.lit(0), lambda a, b: a + b)

    return F.transform(
        found,
        lambda m, i: F.struct(
            m.alias("text"),
            (add(F.slice(between, F.lit(1), i + 1)) + add(F.slice(inside, F.lit(1), i)) + 1).alias("line"),
        ),
    )


def explode_structs(df: DataFrame, array: Column, drop=("content",), ordinal: str | None = None) -> DataFrame:
    """One row per struct, with its fields as columns beside the kept columns."""
    keep = [c for c in df.columns if c not in drop]
    if ordinal:
        out = df.select(*keep, F.posexplode(array).alias("_pos", "_item"))
        return out.select(*keep, (F.col("_pos") + 1).alias(ordinal), "_item.*")
    return df.select(*keep, F.explode(array).alias("_item")).select(*keep, "_item.*")


def explode_values(df: DataFrame, drop=("content",), **arrays: Column) -> DataFrame:
    """Rows (kind, value) for several string arrays, distinct inside each row and kind."""
    def tag(kind, values):
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return explode_structs(df, F.concat(*[tag(k, a) for k, a in arrays.items()]), drop)
