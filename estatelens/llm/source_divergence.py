"""Operator 12: how far the sources of a language differ in their words, from exact sparse count vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.common import per_batch, read, sliced, stage, utf8

MIN_DOCS = 10  # documents of a language that a term is in at least
SCALE = 1_000_000_000
TOP = 10  # terms that a group reports

#: Letters and bytes of other scripts in terms; A-Z as a-z, all else a blank.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(data: bytes, size: int = 1 << 20) -> Counter:
    """Occurrences of each term; a long text is counted in runs, so only its distinct terms are held."""
    found, at = Counter(), 0
    while at < len(data):
        end = at + size
        while end < len(data) and _TERMS[data[end]] != 0x20:
            end += 1
        found.update(data[at:end].translate(_TERMS).split())
        at = end
    return found


def document_vectors(docs: DataFrame) -> DataFrame:
    """(lang, source, terms, counts) of every row: its sparse vector over all terms, without a cap on the vocabulary."""
    def run(batches):
        for batch in sliced(batches):
            vectors = [term_counts(t) for t in utf8(batch.column(2))]
            ends = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
            terms = pa.array([t for v in vectors for t in v], pa.binary()).cast(pa.string())
            counts = pa.array([n for v in vectors for n in v.values()], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, counts)],
                                  names=["lang", "source", "terms", "counts"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string").alias("text"))
    return per_batch(rows, run, "lang string, source string, terms array<string>, counts array<bigint>")


def group_sums(vectors: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): vectors added up per group, in each task first; a null term stands for a group without any."""
    rows = vectors.select("lang", "source", F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n"))))
    return rows.groupBy("lang", "source", "term").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("term").alias("docs"))


def vocabulary(sums: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of `sums` whose term at least `min_docs` documents of the language hold, with the language's count of it.

    `head` marks one row per term and language. The vocabulary stays distributed, a row per term.
    """
    own = Window.partitionBy("lang", "term")
    kept = sums.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(own).alias("docs"), F.sum("n").over(own).alias("lang_n"),
                                                 (F.row_number().over(own.orderBy("source")) == 1).alias("head"))
    return kept.where(F.col("docs") >= min_docs).drop("docs")


def share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    held = {"n": n, "total": total, "terms": terms}
    over, under = ((held["n"].cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)"), held["total"].cast("decimal(20,0)") + held["terms"].cast("decimal(20,0)") * 2)
    return F.when(terms > 0, F.call_function("div", over, under) + 1)


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def pair_values(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, other, value) for source < other: the sum of gaps over the language's vocabulary.

    With z a group's share of a term that it lacks, the sum over all terms is
    sum over the one's terms of gap(p, z') + sum over the other's of gap(z, q) + (terms - both sizes) * gap(z, z')
    + sum over shared terms of gap(p, q) - gap(p, z') - gap(z, q) + gap(z, z').
    The first two follow from the histogram of a group's shares; only shared terms are joined.
    """
    side = lambda df, **names: df.select("lang", *[F.col(c).alias(a) for c, a in names.items()])
    pairs = side(groups, source="source", z="z", size="size", terms="terms").join(side(groups, source="other", z="y", size="other_size"), "lang").where("source <> other")
    steps = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    own = steps.join(pairs.select("lang", "source", "other", "y"), ["lang", "source"]).groupBy("lang", "source", "other").agg(F.sum(F.col("k") * gap("p", "y")).alias("v"))
    mirrored = own.select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), "v")
    absent = pairs.where("source < other").select("lang", "source", "other", ((F.col("terms") - F.col("size") - F.col("other_size")) * F.coalesce(gap("z", "y"), F.lit(0))).alias("v"))
    shared = side(kept, term="term", source="source", p="p", z="z").join(side(kept, term="term", source="other", p="q", z="y"), ["lang", "term"]).where("source < other") \
        .groupBy("lang", "source", "other").agg(F.sum(gap("p", "q") - gap("p", "y") - gap("z", "q") + gap("z", "y")).alias("v"))
    return mirrored.unionByName(absent).unionByName(shared).groupBy("lang", "source", "other").agg(F.sum("v").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): see the query.

    Documents become exact sparse vectors, as CountVectorizer makes them with minDF and the largest vocabSize
    (tests compare both); that class holds the vocabulary on the driver and in each task, here its
    terms are rows. Vectors are added up per (lang, source), and pairs of groups are evaluated on the terms that they share.
    Null texts, langs and sources are ''. Every row is a document, repeated ones too; doc_id and other columns are
    not read. A group without kept terms has equal shares; a language without any has value 0 for all pairs.
    Ties go to the smaller item by UTF-8 bytes; without documents there are no rows.
    """
    sums = stage(group_sums(document_vectors(docs)))
    kept = stage(vocabulary(sums, min_docs))
    langs = kept.groupBy("lang").agg(F.sum(F.col("head").cast("bigint")).alias("terms"), F.sum(F.when(F.col("head"), F.col("lang_n"))).alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    groups = sums.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left") \
        .na.fill(0, ["size", "total", "terms", "lang_total"])
    groups = stage(groups.withColumn("z", share(F.lit(0), "total", "terms")))
    shares = stage(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "z", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q")))

    values = pair_values(groups, shares)
    both = values.select("lang", F.inline(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))), "value")
    words = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(both.withColumn("rank", rank), "pair").unionByName(columns(words.withColumn("rank", rank).where(F.col("rank") <= top), "term"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of sources of a language, and the ten terms that set each source off, over all documents."""
    return divergence(read(spark, folder, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row FROM words),
terms AS (SELECT lang, source, row, unnest(w) AS term FROM numbered),
vocabulary AS (SELECT lang, term, count(*)::HUGEINT AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM vocabulary GROUP BY lang),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM words) g LEFT JOIN found USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, w.term, coalesce(f.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (w.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN vocabulary w USING (lang) JOIN langs l USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = w.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM told)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
