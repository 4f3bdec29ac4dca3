"""Facts from PySpark text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.matches import explode_structs, group, matches
from estatelens.functions.text import find_many
from estatelens.operators.sql_scripts import strip

# --- Fixed values: patterns on PySpark text -----------------------------------
READS = [
    r"""\.read\.(?:parquet|csv|json|orc|avro|table)\(["']([^"']+)["']""",
    r"""\.table\(["']([^"']+)["']""",
    r"""spark\.read\(["']([^"']+)["']""",
]
WRITES = [
    r"""\.write\.(?:parquet|csv|json|orc|avro|saveAsTable)\(["']([^"']+)["']""",
    r"""\.saveAsTable\(["']([^"']+)["']""",
]
FILTER = r"""\.(?:filter|where)\(["']?([^"'()]+)["']?\)"""
JOIN = r"""\.join\(([^,]+),\s*(?:on=)?([^,)]+)(?:,\s*how=["']([^"']+)["'])?\)"""
GROUP = r"\.groupBy\(([^)]+)\)\.agg\(([^)]+)\)"
SELECT = r"\.select\(([^)]+)\)"


def pyspark_io(scripts: DataFrame) -> DataFrame:
    """Rows (direction, location_type, path); `/` and `dbfs:` paths are files, else tables."""
    def rows(direction, values):
        return F.transform(F.array_distinct(values), lambda v: F.struct(
            F.lit(direction).alias("direction"),
            F.when(v.startswith("/") | v.startswith("dbfs:"), "file").otherwise("table").alias("location_type"),
            v.alias("path")))
    items = F.concat(rows("read", find_many("content", READS)), rows("write", find_many("content", WRITES)))
    return explode_structs(scripts, items)


def _names(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda c: F.regexp_replace(strip(c), r"""^["']+|["']+$""", ""))


def pyspark_steps(content="content") -> Column:
    none, no_cols = F.lit(None).cast("string"), F.array().cast("array<string>")

    def step(kind, m, condition=none, join_type=none, columns=no_cols):
        return F.struct(kind.alias("kind"), m.alias("snippet"), condition.alias("condition"),
                        join_type.alias("join_type"), columns.alias("columns"))

    def join(m):
        how = F.coalesce(F.nullif(group(m, JOIN, 3), F.lit("")), F.lit("inner"))
        return step(F.when(how == "inner", "join").otherwise("left_join"), m,
                    condition=strip(group(m, JOIN, 2)), join_type=F.concat(F.upper(how), F.lit(" JOIN")))

    return F.concat(
        F.transform(matches(content, FILTER), lambda m: step(F.lit("filter"), m, condition=strip(group(m, FILTER, 1)))),
        F.transform(matches(content, JOIN), join),
        F.transform(matches(content, GROUP), lambda m: step(F.lit("group_by"), m, columns=_names(strip(group(m, GROUP, 1))))),
        F.transform(matches(content, SELECT), lambda m: step(F.lit("transform"), m, columns=_names(strip(group(m, SELECT, 1))))),
    )


def pyspark_transformations(scripts: DataFrame) -> DataFrame:
    """Filter, join, grouping and projection rows, numbered within the script."""
    return explode_structs(scripts, pyspark_steps(), ordinal="step_no")
