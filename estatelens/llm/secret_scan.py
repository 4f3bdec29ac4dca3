"""Operator 3: secrets in texts, with a trigram index ahead of the regular expressions."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import read, stage

# Kinds of secrets in the order of their spans; least length of the match or of its group.
RULES: dict[str, str] = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "github": r"gh[oprsu]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "key": r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----(?:.*?-----END [A-Z ]*PRIVATE KEY-----|.*)",
    "url": r"[a-z]+://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%-]+@",
}
LEAST: dict[str, tuple[int, int]] = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}
BASE = ("assign", "access", "hex")
MOST = 64  # literal strings that a part of a pattern is spelt out to; beyond it the part gives no trigram


def _spelt(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """Of a parsed pattern: all strings it matches, or None; and clauses of trigrams (any of them, all in it).

    A run of spelt parts is multiplied out; where it ends, each of its strings turns into the set of
    its trigrams. A clause list with an empty clause asks for nothing.
    """
    strings, clauses = {""}, [frozenset()]
    whole = True

    def end_run():
        nonlocal strings, clauses
        clauses = _all(clauses, [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])
        strings = {""}

    for kind, value in items:
        name, own, inner = str(kind), None, [frozenset()]
        if name == "LITERAL":
            own = {chr(value).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            own = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            own, inner = _spelt(value[-1])
        elif name == "BRANCH":
            parts = [_spelt(p) for p in value[1]]
            own = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            inner = [c for _, clause in parts for c in clause]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = value
            own, inner = _spelt(part)
            if own is not None and high == 1 and low == 0:
                own = own | {""}
            elif own is not None and low == high and len(own) == 1:
                own = {s * low for s in own}
            else:
                inner = inner if low else [frozenset()]
                if low and own is not None:
                    inner = _all(inner, [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in own])
                own = None
        elif name == "AT":
            own = {""}
        if own is not None and len(own) * len(strings) <= MOST:
            strings = {a + b for a, b in product(strings, own)}
        else:
            whole = False
            end_run()
            if own is not None and len(own) <= MOST:
                strings = own
            clauses = _all(clauses, inner)
    if whole:
        return strings, [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    end_run()
    return None, clauses


def _all(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    """Both hold; clauses that another one implies are left out."""
    found = {x | y for x, y in product(a, b)}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams: a text that matches has all of one clause. None: scan every text."""
    clauses = sorted(set(_spelt(re._parser.parse(pattern))[1]), key=sorted)
    return None if not clauses or frozenset() in clauses else clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id, body) of the trigrams that some rule asks for."""
    lower = docs.select("doc_id", "body", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    return lower.select("doc_id", "body", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """(doc_id, body, rules) by intersecting the posting lists of each clause."""
    clauses = [(rule, clause) for rule, all_of in queries.items() for clause in all_of]
    users = F.array(*[F.array(*[F.lit(i) for i, (_, c) in enumerate(clauses) if t in c]) for t in trigrams])
    need = F.array(*[F.lit(len(c)) for _, c in clauses])
    name = F.array(*[F.lit(rule) for rule, _ in clauses])
    met = index.select("doc_id", "body", F.explode(F.get(users, F.col("trigram"))).alias("clause"), "trigram") \
        .groupBy("doc_id", "body", "clause").agg(F.countDistinct("trigram").alias("n")) \
        .where(F.col("n") == F.get(need, F.col("clause")))
    return met.groupBy("doc_id", "body").agg(F.collect_set(F.get(name, F.col("clause"))).alias("rules"))


def _spans(rule: str, pattern: str, asked: Column) -> Column:
    """Spans of the matches that are long enough, by code points: texts between matches give the places."""
    text = F.col("text")
    group, least = LEAST.get(rule, (0, 0))
    if rule == "hex":  # a shorter run never fits, so only long ones need to be cut out
        pattern, least = f"[0-9a-f]{{{least},}}", 0
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    kind = F.lit(list(RULES).index(rule))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        long = F.length(F.regexp_extract(pair["hit"], pattern, group)) >= least if least else pair["hit"].isNotNull()
        span = F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(long, F.lit(False)), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.coalesce(asked, F.lit(False)) & F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def scan(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(row, text, spans): each row of `docs` whole and its secrets, as (start, kind, end) by start, then kind.

    Each rule becomes a Boolean query over trigrams; an inverted index of the trigrams asked for gives
    each clause's documents, and the expressions run on these only. Rules without a mandatory trigram
    run on every text. A null text is empty. Rows that repeat a doc_id with another text are told apart
    by a hash of it; a private key reaches to its last line, or without one to the end of the text; equal rows get equal results; a null doc_id is a document like others. Columns
    besides doc_id and text travel in `row`.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    queries = {rule: clauses for rule, pattern in rules.items() if (clauses := trigram_query(pattern))}
    trigrams = sorted({t for clauses in queries.values() for c in clauses for t in c})
    if trigrams:
        found = candidates(stage(postings(rows, trigrams)), queries, trigrams).withColumnsRenamed({"doc_id": "of_id", "body": "of_body"})
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body")), "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<string>"))
    asked = {rule: F.array_contains("rules", rule) if rule in queries else F.lit(True) for rule in rules}
    return rows.select("row", "text", F.array_sort(F.concat(*[_spans(r, p, asked[r]) for r, p in rules.items()])).alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each run of overlapping spans; `spans` by start."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, span["start"] - s["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    return F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    found = scan(read(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == list(RULES).index(k))).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, (rule, pattern) in enumerate(RULES.items()):
        group, least = LEAST.get(rule, (0, 0))
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT doc_id, {k} AS kind, '{rule}' AS name, unnest(hits) AS hit, unnest(list_transform(range(1, len(hits) + 1),
      lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))) AS start,
    {least} AS least, {p} AS pattern, {group} AS grp
  FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, regexp_split_to_array(t, {p}) AS gaps FROM texts WHERE regexp_matches(t, {p}))""")
    lengths = "length(CASE WHEN grp = 2 THEN regexp_extract(hit, '" + RULES["assign"].replace("'", "''") + "', 2) ELSE hit END)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT doc_id, kind, start, name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS s FROM hits WHERE {lengths} >= least)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM texts t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
"""


ORACLE = _oracle()
