"""Operator 2: rule statistics of texts and an isolation forest over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import documents, per_batch, read, stage, utf8

WINDOW = 8  # words of a window that may repeat
TREES = 200
SAMPLE = 256  # rows that a tree is grown from
FIT_ROWS = 20_000  # labelled rows, by hash of the doc_id, that the trees draw from: the bound on what the driver holds
BUCKETS = 4096  # score steps of the calibration
PRIOR = 100  # words without finds that each text is given besides, so that short texts do not stand out by chance
LETTERS = 5  # letters of such a word
LINE = 10  # words of a line: PRIOR words are PRIOR / LINE lines
LONG = 10  # letters a word that count as a word_length of 1
COST = 20.0  # rejecting a good document counts as this many bad ones kept
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# steps of a rate of 1: wide ones for rates that vary in clean texts, so that the variation stays within a step
GRADES = {"word_length": 4, "symbols": 20, "dup_lines": 3, "repeat_words": 3, "capitals": 20, "exclaims": 20, "digits": 5, "stutter": 20}
RATES = list(GRADES)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\x0b\f\r")] = 1
_CLASS[list(SYMBOLS)] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[list(b"!?")] = 4
_CLASS[ord("0") : ord("9") + 1] = 5
_CLASS[0x80:0xC0] = 6  # bytes that go on with a code point


def repeat_words(ids: np.ndarray) -> int:
    """Words inside windows that occur twice or more: equal windows get equal ranks, by doubling."""
    if len(ids) <= WINDOW:
        return 0
    rank, step = ids, 1
    while step < WINDOW:
        _, rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)
        if len(rank) == rank.max() + 1:
            return 0
        step *= 2
    again = np.flatnonzero(np.bincount(rank)[rank] > 1)
    marks = np.zeros(len(ids) + 1, np.int64)
    marks[again] += 1
    marks[again + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def describe(data: bytes) -> list[float]:
    """COUNTS, then RATES, of a whole text in UTF-8.

    A rate is letters a word (of LONG), symbols a word, repeated lines a line, words in repeated windows a
    word, capitals A-Z a letter, marks ! and ? a word, digits a letter, or words like the one before a word,
    in steps by GRADES; within a step texts are alike, so ordinary variation of clean texts isolates nothing.
    """
    words = data.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS) + [0.0] * len(RATES)
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    chars = int(len(data) - kinds[1] - kinds[6])
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup, repeat = len(lines) - len(set(lines)), repeat_words(ids)
    more, letters = n + PRIOR, chars + LETTERS * PRIOR
    rates = [letters / more / LONG, kinds[2] / more, dup / (len(lines) + PRIOR / LINE), repeat / more, kinds[3] / letters, kinds[4] / more,
             kinds[5] / letters, int((ids[1:] == ids[:-1]).sum()) / more]
    return [n, chars, int(kinds[2]), dup, repeat, *(round(float(r) * g) / g for r, g in zip(rates, GRADES.values()))]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long), RATES (double) and base_failed of every document; a null text has no words."""
    def run(batches):
        for batch in batches:
            rows = [describe(t) for t in utf8(batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * (len(COUNTS) + len(RATES))
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]],
                                   *[pa.array(c, pa.float64()) for c in columns[len(COUNTS) :]]], names=["doc_id", *COUNTS, *RATES])

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{c} double" for c in RATES]])
    return per_batch(documents(docs), run, schema).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation forest: trees of random splits; the sooner a row stands alone, the higher its score."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)] if len(rows) else []
        self.threshold = np.inf

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        depth = int(np.ceil(np.log2(max(2, len(rows)))))
        nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, path length of a leaf
        todo = [(rows, 0, -1, 0)]
        while todo:
            part, level, parent, side = todo.pop()
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            low, high = part.min(axis=0), part.max(axis=0)
            spread = np.flatnonzero(high > low)
            if level == depth or not len(spread):
                nodes.append([-1, 0.0, 0, 0, level + float(_expected(len(part)))])
                continue
            feature = int(rng.choice(spread))
            cut = rng.uniform(low[feature], high[feature])
            below = part[:, feature] < cut
            at = len(nodes)
            nodes.append([feature, cut, 0, 0, 0.0])
            if below.all() or not below.any():
                nodes[at] = [-1, 0.0, 0, 0, level + float(_expected(len(part)))]
                continue
            todo += [(part[below], level + 1, at, 0), (part[~below], level + 1, at, 1)]
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; above a half is unusual."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        paths = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := feature[at] >= 0).any():
                go = rows[every, np.maximum(feature[at], 0)] < cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            paths += length[at]
        return 2.0 ** (-paths / len(self.trees) / max(float(_expected(self.sample)), 1e-9))


def score(found: DataFrame, forest: Forest) -> DataFrame:
    """`found` with score and kept."""
    @F.pandas_udf("double")
    def scores(*rates: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack([r.to_numpy(float) for r in rates], axis=1)))

    return found.withColumn("score", scores(*RATES)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") < F.lit(float(forest.threshold))))


def fit(found: DataFrame, labels: DataFrame) -> Forest:
    """The forest of labelled rows that pass the rules, and the threshold that serves all of them best.

    The trees draw from FIT_ROWS labelled rows at most; the threshold is set by a histogram of the
    scores of every labelled row, as the step where rejected bad rows less COST times rejected good
    ones, each as a share of its kind, is largest. Without good and bad labels nothing is rejected but
    by the rules. A document with several labels counts with each.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where("doc_id is not null and quality is not null")
    marked = stage(found.where(~F.col("base_failed")).select("doc_id", "base_failed", *RATES).join(known, "doc_id"))
    rows = stage(marked.orderBy(F.xxhash64("doc_id"), *RATES, "quality").limit(FIT_ROWS).select(*RATES)).toPandas()
    forest = Forest(rows.to_numpy(float))
    step = F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    counts = score(marked, forest).groupBy(step.alias("step"), (F.col("quality") > 0).alias("good")).count().collect()
    tally = np.zeros((2, BUCKETS + 1))
    for r in counts:
        tally[int(r["good"]), r["step"]] += r["count"]
    if tally.sum(axis=1).all():
        above = tally[:, ::-1].cumsum(axis=1)[:, ::-1] / tally.sum(axis=1, keepdims=True)
        gain = above[0] - COST * above[1]
        forest.threshold = (BUCKETS - int(np.argmax(gain[::-1]))) / BUCKETS
    return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, score and verdict of every row of `docs`: doc_id, COUNTS, base_failed, kept, score, RATES.

    Null, empty and blank texts have no words and fail the rules. Repeated rows get equal results;
    columns besides doc_id and text are ignored; without documents there are no rows.
    """
    found = stage(statistics(docs))
    return score(found, fit(found, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "score", *RATES)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns."""
    forest = fit(stage(statistics(docs)), labels)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        rows = np.array([describe(t.encode() if t is not None else b"") for t in text], float).reshape(len(text), -1)
        failed = (rows[:, 0] < 20) | (100 * rows[:, 4] > 30 * rows[:, 0])
        return pd.Series(~failed & (forest.score(rows[:, len(COUNTS) :]) < forest.threshold))

    return docs.where(passes(F.col("text").cast("string")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics and verdict of every document, with thresholds from `labels`."""
    return judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
