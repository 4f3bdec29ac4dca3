"""Writers: reports as JSON, CSV or Markdown, split by type, or capped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.scale import number_rows


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays or structs: write them as JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    for c in nested:
        df = df.withColumn(c, F.to_json(c))
    return df


def markdown_lines(df: DataFrame, title: str) -> DataFrame:
    """Rows as Markdown sections: a heading from the first column, a list of the others."""
    first, rest = df.columns[0], df.columns[1:]
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A"))
    lines = [F.concat(F.lit(f"### {title}: "), text(first))]
    lines += [F.concat(F.lit(f"- **{c}**: "), text(c)) for c in rest]
    return _flat(df).select(F.concat_ws("\n", *lines, F.lit("")).alias("value"))


def write_report(df: DataFrame, path: str, fmt: str, title: str = "Report") -> None:
    """Writes a report; every task writes its own part, nothing passes through the driver."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        _flat(df).write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "markdown":
        markdown_lines(df, title).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_by_type(df: DataFrame, path: str, by: str = "gap_type") -> None:
    """One folder per type. A hot type is written by many tasks: rows are not regrouped."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def cap_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first `n` rows in a stable order, without a single sorting task.

    Only the order's columns are numbered, to find the key of row `n`; rows up to it are then filtered. Of
    rows equal in all these columns at the cut as many stay as have room.
    """
    if n <= 0:
        return df.limit(0)
    keys = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    numbered = number_rows(keys, keys.columns, name="_no")
    cut = numbered.where(F.col("_no") == n).first()
    if cut is None:
        return df
    types = dict(keys.dtypes)
    last = F.struct(*[F.lit(cut[k]).cast(types[k]).alias(k) for k in keys.columns])
    own = F.struct(*[F.col(c).alias(k) for c, k in zip(order, keys.columns)])
    before = numbered.where(F.struct(*keys.columns) < last).count()
    return df.where(own < last).unionByName(df.where(own == last).limit(n - before))
