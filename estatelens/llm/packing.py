"""Operator 8: packs tokens of documents into sequences, as cutting stock by column generation."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm.common import documents, per_batch, read, stage

CAPACITY = 1024
STEPS = 256  # lengths of the linear program: pieces count as the next 1/STEPS of the capacity
END = 0  # id after each document
GAP = 1e-4  # the linear program stops within this share of its lower bound
ROUNDS = 6000  # or after so many columns; fewer columns cost padding, not correctness
RANKED = 200_000  # pieces of a bucket in which one task ranks pieces

# Fixed value: the pattern that splits texts ahead of the merges of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level BPE file of `tokenizers`, special strings included as that library reads them.

    The merges run in tiktoken, whose ids are the same for a vocabulary in order of merges; texts that
    hold the string of an added token go to `tokenizers` itself, as does a file of another kind.
    """

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec.get("added_tokens") or ()}
        self.special = sorted(added)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        ordered = [bytes(letters[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part) for m in spec["model"]["merges"]]
        same = sorted(vocab.values()) == list(range(len(vocab))) and [vocab[m] for m in ordered] == list(range(256, len(vocab)))
        self.fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}) if same else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and END, cut into full sequences and a rest.

    A null text is empty: its one id is END. Every row of `docs` is a document of its own.
    """
    def run(batches):
        encode = encoder(path)
        end = np.array([END], np.uint32)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5,
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return per_batch(documents(docs), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming over the room used."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := fitting[room]:
            worth = price[:k] + value[room - sizes[:k]]
            best = int(worth.argmax())
            if worth[best] > value[room] + 1e-12:
                value[room], taken[room] = worth[best], best
    count, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            count[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(value[capacity]), count


def greedy(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """Patterns filled with the longest pieces left, how often to use each, in fractions, and the sizes that it uses up."""
    out, left = [], demand.astype(float)
    while left.any():
        pattern, room, most = np.zeros(len(sizes), int), capacity, np.ceil(left).astype(int)
        while (fits := np.flatnonzero((most > pattern) & (sizes <= room))).size:
            i = int(fits[-1])
            pattern[i] += min(int(most[i] - pattern[i]), room // int(sizes[i]))
            room = capacity - int(pattern @ sizes)
        held = pattern > 0
        times = float((left[held] / pattern[held]).min())
        rest = np.where(held, left - times * pattern, left)
        ended = held & (rest < 1e-9)
        out.append((pattern, times, np.flatnonzero(ended)))
        left = np.where(ended, 0.0, rest)
    return out


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to use each, in fractions: the simplex method with columns priced by `best_pattern`.

    It starts from the greedy patterns. Each of them uses up a size that later ones lack, so with
    unit patterns for sizes that ended together they are a basis.
    """
    n = len(sizes)
    basis, use, inverse, done = np.zeros((n, n)), np.zeros(n), np.zeros((n, n)), []
    for pattern, times, ended in greedy(sizes, demand, capacity):
        basis[ended[0]], use[ended[0]] = pattern, times
        for i in ended:
            basis[i, i] = max(1, basis[i, i])
            row = -(basis[done, i][:, None] * inverse[done]).sum(axis=0)  # the basis is triangular in this order
            row[i] += 1
            inverse[i] = row / basis[i, i]
            done.append(i)
    bound = float(demand @ sizes) / capacity
    for _ in range(ROUNDS):
        price = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, np.maximum(price, 0), capacity)
        bound = max(bound, use.sum() / worth)  # price / worth is feasible for the dual
        if worth <= 1 + 1e-9 or use.sum() <= max(bound * (1 + GAP), bound + 0.5):
            break
        held = np.flatnonzero(pattern)
        change = (inverse[:, held] * pattern[held]).sum(axis=1)
        ratio = np.full(n, np.inf)
        grows = change > 1e-9
        ratio[grows] = np.maximum(use[grows], 0) / change[grows]
        out = int(ratio.argmin())
        use = use - ratio[out] * change
        use[out] = ratio[out]
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        basis[out] = pattern
    return basis.astype(int), np.maximum(use, 0)


def plan(histogram: dict[int, int], capacity: int = STEPS) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ((size, count), ...) with the number of sequences of each; every piece has a place.

    Fractions are rounded down; what is left, a few pieces per pattern, goes longest first into
    sequences that are filled with the longest pieces that fit.
    """
    out = [([(capacity, 1)], histogram[capacity])] if histogram.get(capacity) else []
    sizes = np.array(sorted(k for k in histogram if k < capacity), int)
    if not len(sizes):
        return out
    left = np.array([histogram[k] for k in sizes], int)
    patterns, use = relaxed(sizes, left.astype(float), capacity)
    for pattern, times in sorted(zip(patterns, np.floor(use + 1e-6).astype(int)), key=lambda x: -x[1]):
        held = pattern > 0
        times = min([times, *(left[held] // pattern[held])])
        if times > 0:
            left = left - times * pattern
            out.append(([(int(sizes[i]), int(pattern[i])) for i in np.flatnonzero(held)[::-1]], int(times)))
    while left.any():
        room, pattern = capacity, {}
        while (fits := np.flatnonzero((left > 0) & (sizes <= room))).size:
            i = int(fits[-1])
            take = min(int(left[i]), room // int(sizes[i]))
            pattern[int(sizes[i])] = take
            left[i] -= take
            room -= take * int(sizes[i])
        out.append((list(pattern.items()), 1))
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size, by rank among the pieces of that size: first rank, first sequence, pieces a sequence, slot of the first there."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        slot = 0
        for size, count in pattern:
            found.setdefault(size, []).append((ranks.get(size, 0), first, count, slot))
            ranks[size] = ranks.get(size, 0) + times * count
            slot += count
        first += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows)) for size, rows in found.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    Documents are cut into full sequences and a rest shorter than `capacity`; a piece's size is its
    length in steps of `capacity` / STEPS, rounded up. The histogram of sizes, STEPS numbers whatever
    the corpus, is all that reaches the driver; there column generation finds the patterns. Pieces of a
    size are ranked by doc_id within hash buckets, with offsets from bucket counts; a piece's rank tells
    its sequence and slot, and the lengths of the slots before it its offset. Null ids, repeated rows
    and columns of other names do no harm; without documents there are no pieces.
    """
    step = -(-capacity // STEPS)
    cut = stage(pieces(docs, path, capacity)).withColumn("size", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}
    table = places(plan(histogram, capacity // step))
    buckets = max(1, sum(histogram.values()) // RANKED)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    ahead = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("size", "bucket").agg(F.count("*").alias("n")) \
        .select("size", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("at", F.row_number().over(inside)).join(offsets, ["size", "bucket"]) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("at") - 1).alias("rank"))

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (5, 6))
            sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
                ranks, firsts, counts, slots = table[int(size[own[0]])]
                k = np.searchsorted(ranks, rank[own], side="right") - 1
                past = rank[own] - ranks[k]
                sequence[own] = firsts[k] + past // counts[k]
                slot[own] = slots[k] + past % counts[k]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(slot)],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = per_batch(ranked, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 1024 byte-level BPE ids over all documents."""
    return pack(read(spark, folder, "documents"), vocabulary())
