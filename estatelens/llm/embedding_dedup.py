"""Operator 7: near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import per_batch, read, stage
from estatelens.llm.components import connected

COSINE = 0.95
PROBES = 3  # buckets of a table that a vector is put into
MISS = 5e-4  # chance that a pair right at the threshold shares no bucket
OCCUPANCY = 4  # vectors that a bucket should hold when directions are even
BLOCK = 1024  # vectors of a bucket that one side of a verification task holds
EDGES = 500_000  # pairs handled at once when first meetings are looked up


class Hashes:
    """`tables` tables of `each` cross-polytope hashes over `dim` dimensions.

    A hash flips signs at random and applies the Hadamard transform, three times over, and names the
    nearest of the 2 * width signed axes. A bucket is a table and the axes of its hashes; the other
    probes of a table change the one axis to its runner-up that costs least.
    """

    def __init__(self, dim: int, each: int, tables: int, seed: int = 3):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.each, self.tables = each, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, each, 3, self.width))

    def _axes(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        for flips in self.signs[table, k]:
            x = x * flips
            step = 1
            while step < self.width:
                y = x.reshape(len(x), -1, 2, step)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.width)
                step *= 2
            x = x / math.sqrt(self.width)
        return x

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket numbers; a table has fewer when there are too few axes, and then repeats its first."""
        n = len(vectors)
        x = np.zeros((n, self.width))
        x[:, : vectors.shape[1]] = vectors
        out = np.zeros((n, self.tables, PROBES), np.int64)
        every = np.arange(n)
        axes = 2 * self.width
        for table in range(self.tables):
            own, swaps = np.full(n, table, np.int64), []
            for k in range(self.each):
                y = self._axes(x, table, k)
                size = np.abs(y)
                depth = min(PROBES, self.width)
                order = np.argsort(-size, axis=1, kind="stable")[:, :depth]
                axis = order * 2 + (np.take_along_axis(y, order, 1) < 0)
                top = np.take_along_axis(size, order, 1)
                own = own * axes + axis[:, 0]
                for j in range(1, depth):
                    swaps.append(((top[:, 0] - top[:, j]) ** 2 + 0.0, (axis[:, j] - axis[:, 0]) * axes ** (self.each - 1 - k)))
            out[:, table, :] = own[:, None]
            if swaps:
                cost, change = (np.stack(c, axis=1) for c in zip(*swaps))
                cheapest = np.argsort(cost, axis=1, kind="stable")[:, : PROBES - 1]
                out[:, table, 1 : 1 + cheapest.shape[1]] += np.take_along_axis(change, cheapest, 1)
        return out


def shaped(dim: int, rows: int, cosine: float = COSINE, seed: int = 5) -> Hashes:
    """Hashes a table by the number of vectors, and tables by how often random pairs right at `cosine` meet in one."""
    width = 2 << max(0, (dim - 1).bit_length())
    each = max(1, min(round(math.log(max(2, rows / OCCUPANCY)) / math.log(max(2, width))), int(55 / math.log2(max(2, width)))))
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1000, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    trial = Hashes(dim, each, 8, seed)
    x, y = trial.buckets(a), trial.buckets(b)
    meets = float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
    return Hashes(dim, each, max(1, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - min(meets, 0.999))))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with the key of its vector; and one row per distinct usable vector: smallest vec_id, count."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    plus = F.transform("e", lambda x: x + F.lit(0.0))  # one zero
    rows = rows.withColumn("e", F.when(usable, plus)).withColumns({"h1": F.when(usable, F.xxhash64("e")), "h2": F.when(usable, F.hash(F.reverse("e"), F.size("e")))})
    each = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min_by("e", "vec_id").alias("e"))
    return rows.select("vec_id", "h1", "h2"), each


def _blocks(entries: DataFrame) -> DataFrame:
    """(bucket, lo, hi, rep): where each vector is compared; a bucket of many vectors becomes pairs of blocks."""
    n = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = entries.join(n, "bucket").withColumn("own", own) \
        .select("bucket", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return spread.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep")


def _firsts(hashes: Hashes, x: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs meet in this bucket and in no smaller one: each pair counts once, however often it is found."""
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    b = hashes.buckets(x[rows])
    i, j = place[: len(i)], place[len(i) :]
    best = np.full(len(i), np.iinfo(np.int64).max)
    for table in range(hashes.tables):
        for p in range(PROBES):
            mine = b[i, table, p]
            best = np.where((b[j, table] == mine[:, None]).any(axis=1), np.minimum(best, mine), best)
    return best == bucket


def _compare(hashes: Hashes, cosine: float, bucket: int, lo: int, hi: int, own: list[int], rep: list[int], size: list[int], x: np.ndarray):
    """Link counts (rep, links, null) and star edges (rep, null, other) of one block pair."""
    rep, size, own = np.array(rep), np.array(size), np.array(own)
    near = (x @ x.T) >= cosine
    np.fill_diagonal(near, False)
    if lo != hi:
        near &= own[:, None] != own[None, :]
    links = np.zeros(len(rep), np.int64)
    first, second = np.nonzero(np.triu(near))
    for k in range(0, len(first), EDGES):
        i, j = first[k : k + EDGES], second[k : k + EDGES]
        once = _firsts(hashes, x, i, j, bucket)
        np.add.at(links, i[once], size[j[once]])
        np.add.at(links, j[once], size[i[once]])
    out = [(int(rep[k]), int(links[k]), None) for k in np.flatnonzero(links)]
    open_rows = near.any(axis=1)
    for root in range(len(rep)):
        if not open_rows[root]:
            continue
        group, queue = [root], [root]
        open_rows[root] = False
        while queue:
            found = np.flatnonzero(near[queue.pop()] & open_rows)
            open_rows[found] = False
            group += found.tolist()
            queue += found.tolist()
        least = int(rep[group].min())
        out += [(int(rep[k]), None, least) for k in group if rep[k] != least]
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding).

    Vectors of one length are compared by cosine in double precision. Equal vectors form a class, so
    copies are hashed once and never listed as pairs. Classes that share a bucket are compared block by
    block with a matrix product; pairs are counted in the smallest bucket they share and only counts
    and star edges leave a task. A null or zero vector, one with null or non-finite components, or a row
    without vec_id links with nothing and is its own component. Repeated rows link with each other.
    Vectors of different lengths never link. No rows give no rows; other columns are ignored.
    """
    rows, each = classes(vectors)
    each = stage(each)
    found = None
    for shape in each.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        dim = shape["dim"]
        hashes = shaped(dim, shape["n"], cosine)
        part = each.where(F.size("e") == dim)
        new = _pairs(part, hashes, cosine)
        found = new if found is None else found.union(new)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found)
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = each.select("h1", "h2", "rep", "size").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _pairs(part: DataFrame, hashes: Hashes, cosine: float) -> DataFrame:
    def enter(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = hashes.buckets(_matrix(batch.column(1))).reshape(batch.num_rows, -1)
            buckets = np.sort(buckets, axis=1)
            new = np.concatenate([np.ones((len(buckets), 1), bool), buckets[:, 1:] != buckets[:, :-1]], axis=1)
            reps = np.repeat(batch.column(0).to_numpy(), new.sum(axis=1))
            yield pa.record_batch([pa.array(buckets[new]), pa.array(reps)], names=["bucket", "rep"])

    entries = stage(per_batch(part.select("rep", "e"), enter, "bucket long, rep long"))
    tasks = _blocks(entries).join(part.select("rep", "size", "e"), "rep").select("bucket", "lo", "hi", "own", "rep", "size", "e")

    def compare(batches):
        def done(parts):
            columns = [np.concatenate([p[k] for p in parts]) for k in range(3)]
            return _compare(hashes, cosine, *key, *[c.tolist() for c in columns], np.concatenate([p[3] for p in parts]))

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            values = [batch.column(k).to_numpy() for k in (3, 4, 5)]
            x = _matrix(batch.column(6))
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            start = 0
            for end in ends:
                now = tuple(keys[start].tolist())
                if now != key:
                    out += done(held) if held else []
                    key, held = now, []
                held.append((*(v[start:end] for v in values), x[start:end]))
                start = end
            yield _found(out)
        if held:
            yield _found(done(held))

    return per_batch(tasks.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), compare, "rep long, links long, other long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "other"])


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(read(spark, folder, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
parts AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, p.c AS component_id, e.vec_id = p.c AS kept
FROM embeddings e JOIN parts p ON p.x = e.vec_id LEFT JOIN links l ON l.x = e.vec_id
"""
