"""Operator 10: removes repeated passages of lines, found as equal windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.common import meet, read, stage

SPACE = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(units: Column) -> Column:
    """Windows of three following lines, or of all where there are fewer: first and last position, 96 bits of hash."""
    n = F.greatest(F.size(units) - 2, F.lit(0))
    thrice = F.arrays_zip(F.slice(units, 1, n).alias("a"), F.slice(units, 2, n).alias("b"), F.slice(units, 3, n).alias("c"))
    windows = F.transform(thrice, lambda w: F.struct(
        w["a"]["at"].alias("first"), w["c"]["at"].alias("last"),
        F.xxhash64(w["a"]["line"], w["b"]["line"], w["c"]["line"]).alias("w"),
        F.hash(w["c"]["line"], w["a"]["line"], w["b"]["line"]).alias("c")))
    lines = units["line"]
    whole = F.struct(F.get(units, 0)["at"].alias("first"), F.get(units, F.size(units) - 1)["at"].alias("last"),
                     F.xxhash64(lines).alias("w"), F.hash(F.reverse(lines), F.size(lines)).alias("c"))
    return F.when(F.size(units).between(1, 2), F.array(whole)).otherwise(windows)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, body, first, last, w, c) of every window; `body` tells rows with one doc_id and other texts apart."""
    units = F.filter(F.transform(_lines(F.col("text")), lambda line, at: F.struct(at.alias("at"), line.alias("line"))),
                     lambda u: F.btrim(u["line"], F.lit(SPACE)) != "")
    return docs.select("doc_id", "body", units.alias("units")) \
        .select("doc_id", "body", F.inline(_windows(F.col("units"))))


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, body, spans): merged spans of lines that later occurrences cover.

    The first occurrence is the one of the smallest (doc_id, body, position). It is found by an
    aggregate and joined back by hash, hot windows by a broadcast (`meet`).
    """
    place = F.struct("doc_id", "body", "first", "last")
    firsts = found.groupBy("w", "c").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = F.col("kept")
    same = F.col("doc_id").eqNullSafe(kept["doc_id"]) & (F.col("body") == kept["body"])
    later = meet(found, firsts, ["w", "c"], found.count()).where(~same | (F.col("first") > kept["first"])) \
        .select("doc_id", "body", F.when(same, F.greatest("first", kept["last"] + 1)).otherwise(F.col("first")).alias("f"), F.col("last").alias("l")) \
        .where("f <= l")
    ordered = Window.partitionBy("doc_id", "body").orderBy("f", "l")
    reached = F.max("l").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("f") > reached + 1).cast("int"), F.lit(1))) \
        .withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "body", "island").agg(F.min("f").alias("f"), F.max("l").alias("l"))
    return merged.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("f", "l"))).alias("spans"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(row, text, n_lines, spans): each row of `docs` whole, its text without later occurrences, and what went.

    A window is three following lines that hold more than white space, or all of a text that has only
    one or two, compared by 96 bits of hash; blank lines are stepped over and go when a window covers them. Over all documents the occurrence of the
    smallest (doc_id, hash of the text, position) stays and later ones go, merged where they overlap;
    a later occurrence never takes lines of the first one in the same document. Rows that repeat a
    doc_id and text get the same result. A null text stays null, a blank one is
    kept; a text that is covered whole becomes empty, but for blank lines at its ends. A null doc_id sorts first. Columns besides
    doc_id and text travel in `row`.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    spans = covered(stage(occurrences(rows.drop("row")))).withColumnsRenamed({"doc_id": "of_id", "body": "of_body"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body")), "left") \
        .select("row", "text", "spans", _lines(F.col("text")).alias("lines"))
    spans, lines = F.col("spans"), F.col("lines")

    def gap(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["l"] + 1)
        end = F.coalesce(F.get(spans, k)["f"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), gap))
    return joined.select("row", F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
                         F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce(spans, F.expr("cast(array() as array<struct<f:int,l:int>>)")).alias("spans"))


def removed_lines(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["l"] - s["f"] + 1)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document without the lines of repeated windows: lines before, lines removed, removed spans (from 0, both ends in), text left."""
    found = without_repeats(read(spark, folder, "documents"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["f"], s["l"])), ",")
    return found.select("row.doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"),
                        removed_lines(F.col("spans")).alias("n_removed"), shown.alias("removed"), "text")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
units AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, pos AS f, lead(pos, 2) OVER o AS l, [line, lead(line, 1) OVER o, lead(line, 2) OVER o] AS w
  FROM units WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL SELECT doc_id, min(pos), max(pos), list(line ORDER BY pos) FROM units GROUP BY doc_id HAVING count(*) < 3),
firsts AS (SELECT w, min({'d': doc_id, 'f': f, 'l': l}) AS k FROM windows WHERE l IS NOT NULL GROUP BY w HAVING count(*) > 1),
later AS (
  SELECT doc_id, CASE WHEN doc_id = k.d THEN greatest(f, k.l + 1) ELSE f END AS f, l
  FROM windows JOIN firsts USING (w) WHERE l IS NOT NULL AND (doc_id, f) <> (k.d, k.f)),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS pos FROM later WHERE f <= l),
runs AS (SELECT doc_id, min(pos) AS f, max(pos) AS l FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
spans AS (SELECT doc_id, sum(l - f + 1) AS n, string_agg(f || '-' || l, ',' ORDER BY f) AS s FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed,
  coalesce(s.s, '') AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text
FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
