"""Operator 9: exact Jaccard join of word n-gram sets by partitioning the universe of n-grams."""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import documents, mix, per_batch, read, stage, utf8
from estatelens.llm.components import connected

BAND_RATIO = 1.4  # largest size of a band over the largest size of the band below
SEGMENT = 4.5  # n-grams that a segment of the largest set of a band should hold at least
SPARE = 8.0  # standard deviations of empty segments beyond their mean that the slack covers
HOT_SHARE = 16  # one text in so many, by hash, is counted to find frequent n-grams
HOT_COUNT = 4  # texts of these that a frequent n-gram is in at least
HOT_MOST = 50_000  # frequent n-grams that are left out of segments at first, the most frequent ones
RARE_LEVELS = 2  # seeds tried without them
LEVELS = 24  # seeds tried before empty segments are indexed too
BLOCK = 1_000_000  # n-grams of a cluster that one side of a verification task holds
PIECE = 1 << 20  # bytes of a text hashed at once
SLICES = 2  # signatures are made and met in so many parts, one after the other
RUN = 500_000  # signatures of a task that are brought together before they are sent

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x2545F4914F6CDD1D
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, 1 << 16)
        first = np.ones(1, np.uint64)
        _POWERS = np.cumprod(np.concatenate([first, np.full(n, _BASE, np.uint64)]))
        _INVERSES = np.cumprod(np.concatenate([first, np.full(n, pow(_BASE, -1, 2**64), np.uint64)]))


def _pieces(data: bytes):
    """The text in runs of about PIECE bytes that end between words."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    out = []
    for piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        word = ~_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * _INVERSES[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngram_set(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter text is one n-gram, no word none."""
    words = word_hashes(data.lower())
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return np.unique(grams)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that two sets share when they are equal."""
    return tuple(int(mix(grams, seed).sum(dtype=np.uint64)) - 2**63 for seed in (11, 12))


class Schemes:
    """How sets are partitioned, by size band.

    Sets link when q * intersection >= p * union, so linked sets of at most U n-grams each differ in
    at most H = (q - p) * 2U // (q + p) n-grams. The n-grams are hashed into m segments; segment i has
    v_i = 1 (index what the set has there) or v_i = 2 (index that and all its one-deletions), with
    sum v_i = H + 1 + slack. If every segment differed in at least v_i n-grams, the sets would differ
    in more than H: so linked sets share a signature. Empty segments give no signature; a set whose
    empty segments use up more than the slack is partitioned again with the next seed until one does
    not; after LEVELS seeds, which only tiny sets at low thresholds see, empty segments are indexed
    too. The first RARE_LEVELS seeds leave out frequent n-grams, whose segments would get v = 0: sets
    differ no more without them, and unrelated texts with a line in common share no segment. Which
    n-grams these are changes the cost only. The smaller of two linked sets may be in a lower band, so a set is indexed for each band above
    its own that holds sizes it may link with: at high thresholds the next one, if it is near its edge.
    """

    def __init__(self, p: int, q: int, loads: dict[int, np.ndarray] | None = None, hot: np.ndarray | None = None):
        self.p, self.q, self.loads = p, q, loads or {}
        self.hot = np.zeros(0, np.uint64) if hot is None else np.sort(hot)

    @lru_cache(maxsize=None)
    def edge(self, band: int) -> int:
        """Largest size of a band; sets of band 0 link only if they are equal."""
        if band == 0:
            return max(1, (self.q + self.p - 1) // (2 * (self.q - self.p)))
        return max(self.edge(band - 1) + 1, math.floor(self.edge(band - 1) * BAND_RATIO))

    def bands(self, size: int) -> list[int]:
        band = 0
        while self.edge(band) < size:
            band += 1
        found = [band]
        while self.q * size >= self.p * (self.edge(found[-1]) + 1):
            found.append(found[-1] + 1)
        return [b for b in found if b > 0]

    @lru_cache(maxsize=None)
    def shape(self, band: int) -> tuple[int, int, int]:
        """Segments, segments with one-deletions, slack."""
        top, low = self.edge(band), self.edge(band - 1) + 1
        need = (self.q - self.p) * 2 * top // (self.q + self.p) + 1
        m = max(-(-need // 2), min(need, round(top / SEGMENT)), 1)
        slack = 0
        for _ in range(3):
            double = need + slack - m
            none = (1 - 1 / m) ** low if m > 1 else 0.0
            one = low / m * (1 - 1 / m) ** (low - 1) if m > 1 else 0.0
            mean = none * (m + double) + one * double
            slack = min(2 * m - need, math.ceil(mean + SPARE * math.sqrt(mean)) if mean > 0.05 else 0)
        return m, need + slack - m, slack

    @lru_cache(maxsize=None)
    def allocation(self, band: int) -> np.ndarray:
        """v of each segment: one-deletions where the corpus has the fewest n-grams, as these are the signatures they cost."""
        m, double, _ = self.shape(band)
        load = self.loads.get(band, np.zeros(m))
        v = np.ones(m, np.int64)
        v[np.argsort(load, kind="stable")[:double]] = 2
        return v

    def segments(self, grams: np.ndarray, band: int, level: int) -> np.ndarray:
        m = np.uint64(self.shape(band)[0])
        return (((mix(grams, 100 + level) >> np.uint64(32)) * m) >> np.uint64(32)).astype(np.int64)

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        out, every = [], grams
        rare = every
        if len(self.hot):
            near = np.minimum(np.searchsorted(self.hot, every), len(self.hot) - 1)
            rare = every[self.hot[near] != every]
        for band in self.bands(len(every)):
            m, _, slack = self.shape(band)
            v, level = self.allocation(band), 0
            while True:
                grams = rare if level < RARE_LEVELS else every
                if not len(grams):
                    level = RARE_LEVELS
                    continue
                value = mix(grams, 7)
                where = self.segments(grams, band, level)
                count = np.bincount(where, minlength=m)
                total = np.zeros(m, np.uint64)
                order = np.argsort(where, kind="stable")
                used = np.flatnonzero(count)
                total[used] = np.add.reduceat(value[order], np.concatenate([[0], np.cumsum(count[used])[:-1]]))
                name = mix(np.arange(m, dtype=np.uint64) + np.uint64((band * 4096 + level) << 32), 8)
                last = level == LEVELS
                named = np.arange(m) if last else used
                out.append(mix(total[named] + name[named], 9))
                deletes = (v[where] == 2) & ((count[where] > 1) | last)
                out.append(mix(total[where[deletes]] - value[deletes] + name[where[deletes]], 9))
                lost = v[count == 0].sum() + ((v == 2) & (count == 1)).sum() if m > 1 or level < RARE_LEVELS else 0
                if last or (lost <= slack and (m > 1 or len(grams) > 1 or len(every) == 1)):
                    break
                level += 1
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sets(batches, n: int):
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            yield doc_id, ngram_set(data, n)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def profile(docs: DataFrame, n: int, schemes: Schemes) -> DataFrame:
    """Size and key of each document's set (load null), and the n-grams that a task saw per band and segment (doc_id null)."""
    def run(batches):
        loads: dict[int, np.ndarray] = {}
        rows: list[tuple] = []
        for doc_id, grams in _sets(batches, n):
            rows.append((doc_id, len(grams), *(set_key(grams) if len(grams) else (None, None))))
            for band in schemes.bands(len(grams)) if len(grams) else ():
                m = schemes.shape(band)[0]
                loads[band] = loads.get(band, 0) + np.bincount(schemes.segments(grams, band, 0), minlength=m)
            if len(rows) >= 5000:
                yield _profile_rows(rows)
                rows = []
        yield _profile_rows(rows)
        for band, load in loads.items():
            k = len(load)
            yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                   pa.array([band] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(load, pa.int64())], names=_PROFILE)

    return per_batch(docs, run, "doc_id long, n long, h1 long, h2 long, band int, segment int, load long")


_PROFILE = ["doc_id", "n", "h1", "h2", "band", "segment", "load"]


def _profile_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    k = len(rows)
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns]
                           + [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=_PROFILE)


def met(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(key, node, hub) rows of a run of (signature, node): each signature once, at its first node (hub null), and its other nodes beside that node.

    A signature of a large cluster leaves a run as one row. Rows with a hub have bits of their node
    as key, so those of one hub are spread.
    """
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    hub = node[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([hub, node])[:, hub != node], axis=1)
    keys = np.concatenate([sig[new], _signed(mix(pairs[1].view(np.uint64)))])
    hubs = np.concatenate([np.zeros(new.sum(), np.int64), pairs[0]])
    return pa.record_batch([pa.array(keys), pa.array(np.concatenate([node[new], pairs[1]])), pa.array(hubs, mask=np.arange(len(hubs)) < new.sum())],
                           names=["key", "node", "hub"])


def signatures(docs: DataFrame, n: int, schemes: Schemes, part: int = 0, parts: int = 1) -> DataFrame:
    """`met` rows of all texts, of the signatures of one part; a task looks at equal sets once. node: first half of the set's key."""
    def run(batches):
        seen = set()
        sigs, nodes, held = [], [], 0
        for _, grams in _sets(batches, n):
            if not len(grams) or (key := set_key(grams)) in seen:
                continue
            seen.add(key)
            own = schemes.signatures(grams)
            if parts > 1:
                own = own[mix(own, 13) % np.uint64(parts) == part]
            sigs.append(_signed(own))
            nodes.append(np.full(len(own), key[0], np.int64))
            held += len(own)
            if held >= RUN:
                yield met(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, held = [], [], 0
        if held:
            yield met(np.concatenate(sigs), np.concatenate(nodes))

    return per_batch(docs, run, "key long, node long, hub long")


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """N-grams that many texts hold, from a share of all texts; at most HOT_MOST numbers reach the driver."""
    def run(batches):
        for batch in batches:
            sets = [ngram_set(t, n) for t in set(utf8(batch.column(1)))]
            yield pa.record_batch([pa.array(_signed(np.concatenate(sets) if sets else np.zeros(0, np.uint64)))], names=["g"])

    share = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0)
    top = per_batch(share, run, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_COUNT) \
        .orderBy(F.desc("n"), "g").limit(HOT_MOST)
    found = stage(top.select("g")).toPandas()["g"].to_numpy(np.int64)
    return found.view(np.uint64) ^ np.uint64(1 << 63)


def candidate_edges(rows: DataFrame) -> DataFrame:
    """(a, b): for every two nodes that share a signature, a path between them.

    Rows of a signature meet in one task, at most one of each run of `met`, and are joined to the
    first; a task reads them in order and holds a batch. Rows with a hub are edges already.
    """
    def run(batches):
        last_sig = last_hub = None
        for batch in batches:
            edge = np.asarray(batch.column(2).is_valid())
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            hubs = batch.column(2).fill_null(0).to_numpy().copy()
            sig, mine = key[~edge], node[~edge]
            if len(sig):
                new = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
                starts = np.flatnonzero(new)
                hubs[~edge] = np.concatenate([[last_hub if last_hub is not None else mine[0]], mine[starts]])[np.cumsum(new)]
                last_sig, last_hub = int(sig[-1]), int(hubs[~edge][-1])
            pairs = np.unique(np.stack([hubs, node])[:, hubs != node], axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return per_batch(rows.repartition("key").sortWithinPartitions("key", "node"), run, "a long, b long")


def _components(sets: list[np.ndarray], p: int, q: int) -> list[int]:
    """For each set the index of the first set of its component, by search that counts n-grams shared with sets not reached yet."""
    size = np.array([len(s) for s in sets])
    label = np.full(len(sets), -1)
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [0, 0 if q * shared >= p * (size.sum() - shared) else 1]
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    offset = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)

    def postings(open_sets):
        keep = np.flatnonzero(open_sets[owner])
        keep = keep[np.argsort(token[keep], kind="stable")]
        return np.searchsorted(token[keep], np.arange(token.max() + 2, dtype=np.int32)), owner[keep]

    starts, owners = postings(label < 0)
    left = built = len(sets)
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root], queue, left = root, [root], left - 1
        while queue and left:
            at = queue.pop()
            own = token[offset[at] : offset[at + 1]]
            lo, n = starts[own], starts[own + 1] - starts[own]
            index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owners[index], minlength=len(sets))
            linked = np.flatnonzero((label < 0) & (q * shared >= p * (size + size[at] - shared)))
            label[linked] = root
            queue += linked.tolist()
            left -= len(linked)
            if left < built // 2:
                starts, owners = postings(label < 0)
                built = left
    return label.tolist()


def verified_edges(members: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(a, b): each member of a verified component beside the component's smallest member.

    `members` (root, lo, hi, doc_id, node, text) come sorted by task; all of a block pair are in one.
    """
    def solve(rows):
        by_id = {}
        while rows:  # a text is let go when its set is there
            doc_id, node, data = rows.pop()
            if doc_id not in by_id:
                grams = ngram_set(data, n)
                if len(grams) and set_key(grams)[0] == node:
                    by_id[doc_id] = grams
        ids = sorted(by_id)
        if len(ids) < 2:
            return []
        return [(ids[k], i) for k, i in zip(_components([by_id[i] for i in ids], p, q), ids) if ids[k] != i]

    def run(batches):
        key, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            found = []
            for k, doc_id, node, data in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), utf8(batch.column(5))):
                if k != key:
                    found += solve(rows)
                    key, rows = k, []
                rows.append((doc_id, node, data))
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
        found = solve(rows)
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return per_batch(members.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi"), run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, by Jaccard >= p / q of word n-gram sets.

    Texts are lower-cased in A-Z; words stand between ASCII white space. A text of fewer words is one
    n-gram; null, empty and blank texts have none, link with nothing and are their own component.
    Documents with equal sets form a class and only classes are joined. Signatures (`Schemes`) give
    candidates, whose clusters are verified on the whole sets, large clusters in pairs of blocks.
    Repeated rows get the same result each. A null doc_id has no component of its own: it gets the
    smallest doc_id of its class's component, else null. Other columns are ignored.
    """
    docs = documents(docs)
    plain = Schemes(p, q)
    seen = stage(profile(docs, n, plain))
    loads: dict[int, np.ndarray] = {}
    costs = defaultdict(list)
    for band, segment, load in seen.where("load is not null").groupBy("band", "segment").agg(F.sum("load")).orderBy("band", "segment").collect():
        costs[band].append(load)  # as many numbers as the largest set has segments, whatever the corpus
    loads = {band: np.array(c) for band, c in costs.items()}
    sets = seen.where("load is null").select("doc_id", "n", "h1", "h2")
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = stage(classes.where("rep is not null"))

    schemes = Schemes(p, q, loads, frequent(docs, n))
    # signatures take more room than anything else on the way; the files of a part go before the next one is made
    edges = [stage(candidate_edges(signatures(docs, n, schemes, part, SLICES))) for part in range(SLICES)]
    clusters = connected(reduce(DataFrame.union, edges))
    members = clusters.select(F.col("node").alias("h1"), F.col("component").alias("root")).join(classes, "h1")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.select("rep", F.col("h1").alias("node"), "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("rep", "node", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    members = members.join(docs, members["rep"] == docs["doc_id"]).select("root", "lo", "hi", "doc_id", "node", "text")
    joined = connected(verified_edges(members, n, p, q)).withColumnRenamed("node", "rep")

    of_class = classes.join(joined, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(of_class, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, with all their columns; rows without a doc_id stay."""
    kept = jaccard_components(docs, n, p, q).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "leftsemi").union(docs.where("doc_id is null"))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard >= 0.9."""
    return jaccard_components(read(spark, folder, "documents"), 3, 9, 10)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
