"""Operator 11: what each filter removes under all orders of the filters, by difference arrays over Lehmer ranks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.common import per_batch, read, runs, sliced, stage, utf8

FILTERS = "ABCDE"  # a mask has bit k for the k-th filter that a document fails
SHORT, VARIED, CAPITALS = 100, 80, 10  # words at least, distinct words in a hundred at least, capitals in a hundred at most
COPY = 1 << FILTERS.index("E")
SALTS = 1024  # parts that rows without a doc_id are dealt to

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER_BYTES = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def own_mask(data: bytes) -> int:
    """The filters A to D that a text fails; long texts are read in runs, so only their distinct words are held."""
    n, seen = 0, set()
    for run in runs(data):
        words = run.split()  # splits bytes at ASCII white space
        n += len(words)
        seen.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    letters = len(data.translate(None, _LATER_BYTES))
    fails = n < SHORT, 100 * len(seen) < VARIED * n, 100 * capitals > CAPITALS * letters, _SYMBOL.search(data) is not None
    return sum(bit << k for k, bit in enumerate(fails))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: filters A to D, and 128 bits that equal texts share."""
    def run(batches):
        for batch in sliced(batches):
            texts = utf8(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(map(own_mask, texts), pa.int32()),
                                   pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return per_batch(rows, run, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail exactly these filters, and how many of them are labelled.

    Filter E needs the smallest doc_id of each text. Rows are added up per text first, with the number of
    rows at the group's smallest doc_id, so a text that a third of all rows hold is a few rows by then.
    """
    salt = F.when(F.col("doc_id").isNull(), F.floor(F.rand(7) * SALTS)).otherwise(0).alias("salt")
    rows = stage(described(docs).select("*", salt))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")).withColumn("salt", F.lit(0).cast("bigint"))
    by_id = rows.join(marks, ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"]) \
        .groupBy("doc_id", "salt", "part", "mask", "digest", "good", "toxic").agg(F.count("*").alias("n"))
    texts = by_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"))
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.col("unnamed") + F.when(F.col("low") == F.col("least"), F.col("at_low")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return texts.withColumn("least", least).withColumn("first", first).select("part", "good", "toxic", F.inline(split)) \
        .groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")) \
        .where("docs > 0")


def intervals() -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, start, stop): ranks [start, stop) of the orders in which a document with this mask goes at this step.

    It goes at step k if k - 1 filters that it passes stand before one that it fails. All orders with the same
    first k filters are neighbours in lexicographic order, from the rank that the prefix's Lehmer digits give.
    """
    n = len(FILTERS)
    for mask in range(1, 1 << n):
        failed = [k for k in range(n) if mask >> k & 1]
        passed = [k for k in range(n) if not mask >> k & 1]
        for step in range(1, len(passed) + 2):
            for head in permutations(passed, step - 1):
                for last in failed:
                    prefix = (*head, last)
                    digits = [sum(x < p for x in range(n) if x not in prefix[:i]) for i, p in enumerate(prefix)]
                    start = sum(d * factorial(n - 1 - i) for i, d in enumerate(digits))
                    yield mask, step, start, start + factorial(n - step)


def order_of(rank) -> F.Column:
    """The order of the filters at a lexicographic rank, from its Lehmer digits."""
    rest, order = F.lit(FILTERS), F.lit("")
    for left in range(len(FILTERS), 0, -1):
        digit = F.floor(rank / factorial(left - 1)) % left
        pick = F.substring(rest, (digit + 1).cast("int"), F.lit(1))
        order, rest = F.concat(order, pick), F.replace(rest, pick, F.lit(""))
    return order


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each of the 120 orders does, per part: see the columns of the query.

    Each mask adds its counts where an interval of ranks starts and takes them off where it stops; running
    sums over the ranks of (part, step) are what a step removes. The corpus is read once, for at most 32 masks a part.
    Null texts are empty, null langs the part ''. Every row is a document. A null doc_id is never a copy
    of a smaller one and has no label; rows with the same doc_id are not smaller than each other; of labels
    that repeat, any that says 1 counts. Other columns are ignored; without documents there are no rows.
    """
    spark = docs.sparkSession
    n = len(FILTERS)
    counted = stage(masks(docs, labels))
    bits = [F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 for k in range(n)]
    totals = counted.groupBy("part").agg(
        F.sum("docs").alias("total"), F.array(*[F.sum(F.when(b, F.col("docs")).otherwise(0)) for b in bits]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(0)) for k in range(n)]).alias("alone"))
    spans = F.broadcast(spark.createDataFrame(list(intervals()), "mask int, step int, start int, stop int"))  # 840 rows whatever the corpus
    sums = ["docs", "good", "toxic"]
    ends = F.array(F.struct(F.col("start").alias("rank"), *sums), F.struct(F.col("stop").alias("rank"), *[(-F.col(c)).alias(c) for c in sums]))
    steps = counted.join(spans, "mask").select("part", "step", F.inline(ends)).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    every = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"))
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    removed = every.join(steps, ["part", "step", "rank"], "left").na.fill(0, sums) \
        .select("part", "step", "rank", *[F.sum(c).over(ranks).alias(c) for c in sums], order_of(F.col("rank")).alias("filter_order"))
    removed = removed.withColumn("own", F.substring("filter_order", F.col("step"), F.lit(1)))
    index = F.instr(F.lit(FILTERS), F.col("own"))
    gone = F.sum("docs").over(Window.partitionBy("part", "rank").orderBy("step"))
    shapley = F.sum("docs").over(Window.partitionBy("part", "own"))
    out = removed.select("*", gone.alias("gone"), shapley.alias("shapley")).join(totals, "part")
    return out.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("docs").alias("removed"),
        (F.get("fails", index - 1) - F.col("docs")).alias("redundant"), F.get("alone", index - 1).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The five filters under all 120 orders, per language, over all documents."""
    return audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS low FROM words GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(words.t, '[A-Z]')) > 10 * length(words.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN low < words.doc_id THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN least ON words.t = least.t LEFT JOIN marks ON words.doc_id = marks.doc_id),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o AS filter_order, s AS step, o[s] AS own, o[1:s - 1] AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS s)),
told AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN len(translate(fails, before || own, '')) = len(fails) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(fails, own) AND len(translate(fails, before, '')) = len(fails) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, own) AND len(translate(fails, before, '')) < len(fails) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND len(translate(fails, before, '')) = len(fails) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(fails, own) AND len(translate(fails, before, '')) = len(fails) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""
