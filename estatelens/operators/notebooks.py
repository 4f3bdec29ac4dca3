"""Facts from notebooks: cells, parameters, imports, paths, operations, schemas, SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_values
from estatelens.functions.text import find_all, find_many, words

NOTEBOOK_SCHEMA = "cells ARRAY<STRUCT<cell_type: STRING, source: ARRAY<STRING>>>"
# --- Fixed values: patterns on notebook text ---------------------------------------
WIDGET = r"""dbutils\.widgets\.(?:text|dropdown|combobox|multiselect)\s*\(\s*["']([^"']+)["']"""
RUN = r"""%run\s+["']?([^"'\n]+)["']?"""
IMPORT = r"(?m)^\s*(?:from\s+([^\s]+)|import\s+([^\s,]+))"
READ_PATHS = [r"""(?i)spark\.read\.[a-z]+\(["']([^"']+\.(?:csv|parquet|json|txt|avro|delta))["']""",
              r"""(?i)load\(["']([^"']+)["']"""]
WRITE_PATHS = [r"""(?i)write\.[a-z]+\(["']([^"']+)["']""", r"""(?i)save\(["']([^"']+)["']"""]
INPUT_TABLES = [r"""(?i)spark\.read\.table\(["']([^"']+)["']""", r"""(?i)spark\.table\(["']([^"']+)["']""",
                r"(?i)\bFROM\s+([a-z_][a-z0-9_.]+)", r"(?i)\bJOIN\s+([a-z_][a-z0-9_.]+)"]
OUTPUT_TABLES = [r"""(?i)saveAsTable\(["']([^"']+)["']""", r"""(?i)insertInto\(["']([^"']+)["']""",
                 r"(?i)CREATE\s+(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?([a-z_][a-z0-9_.]+)",
                 r"(?i)INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?([a-z_][a-z0-9_.]+)"]
STRUCT_TYPE = r"(?s)StructType\s*\(\s*\[(.*?)\]\s*\)"
STRUCT_FIELD = r"""StructField\s*\(\s*["']([^"']+)["']"""
SQL_CALL = r"""(?s)spark\.sql\(["']([^"']+)["']\)"""
SQL_MAGIC = r"(?s)%sql\s+(.*?)(?:%|\z)"


def notebook_facts(files: DataFrame) -> DataFrame:
    """Rows (kind, value): parameter, run, module, tables, paths, operation, schema field."""
    runs = F.filter(F.transform(find_all("content", RUN), lambda r: F.trim(r)), lambda r: (r != "") & ~r.startswith("#"))
    names = F.transform(find_all("content", IMPORT, 0), lambda m: F.coalesce(
        F.nullif(F.regexp_extract(m, IMPORT, 1), F.lit("")), F.regexp_extract(m, IMPORT, 2)))
    modules = F.transform(F.filter(names, lambda n: (n != "") & ~n.startswith(".")), lambda n: F.split(n, r"\.").getItem(0))
    operations = F.filter(words(vocab.NOTEBOOK_OPERATIONS), lambda op: F.regexp_like(
        F.col("content"), F.concat(F.lit(r"\."), op, F.lit(r"\s*\("))))
    fields = F.flatten(F.transform(find_all("content", STRUCT_TYPE), lambda s: find_all(s, STRUCT_FIELD)))
    return explode_values(
        files, parameter=find_all("content", WIDGET), run=runs, module=modules,
        input_table=find_many("content", INPUT_TABLES), output_table=find_many("content", OUTPUT_TABLES),
        input_path=find_many("content", READ_PATHS), output_path=find_many("content", WRITE_PATHS),
        operation=operations, schema_field=fields)


def embedded_sql(files: DataFrame) -> DataFrame:
    """SQL texts inside code: `spark.sql(...)` calls, then `%sql` cells."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.explode(find_many("content", [SQL_CALL, SQL_MAGIC])).alias("sql_text"))


def explode_cells(files: DataFrame) -> DataFrame:
    """One row per notebook cell: position, type, source text."""
    keep = [c for c in files.columns if c != "content"]
    cells = files.select(*keep, F.posexplode(F.from_json("content", NOTEBOOK_SCHEMA)["cells"]).alias("cell_no", "cell"))
    return cells.select(*keep, "cell_no", "cell.cell_type", F.array_join("cell.source", "").alias("source"))


def cell_transformations(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Transformation rows per code cell with its code, whole or cut; code cells are numbered from 1 inside the row."""
    keep = [c for c in files.columns if c != "content"]
    code = F.filter(F.from_json("content", NOTEBOOK_SCHEMA)["cells"], lambda c: c["cell_type"] == "code")
    rows = files.select(*keep, F.posexplode(code).alias("pos", "cell")) \
        .select(*keep, (F.col("pos") + 1).alias("cell_no"), F.array_join("cell.source", "").alias("source"))
    src = F.col("source")
    kinds = F.array_compact(F.array(
        F.when(F.trim(src).startswith("%sql"), "sql"),
        F.when(src.contains("filter(") | src.contains("where("), "filter"),
        F.when(src.contains("join("), "join"),
        F.when(src.contains("groupBy(") | src.contains("agg("), "group")))
    return rows.select(*keep, "cell_no", (src if max_chars is None else F.left(src, F.lit(max_chars))).alias("snippet"), F.explode(kinds).alias("kind"))
