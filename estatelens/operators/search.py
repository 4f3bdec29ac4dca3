"""Retrieval: exact and approximate nearest vectors, term weights, BM25, fused ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.scale import cut_lineage, maybe_broadcast, number_rows, small_enough
from estatelens.functions.text import as_col

MAX_QUERIES = 4096
TILE_BYTES = 32 << 20  # vectors of one side in a task of the grid
DIGITS = 9


def _distances(queries: np.ndarray, docs: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of distances, one row per query."""
    dots = queries @ docs.T
    q2, d2 = (queries ** 2).sum(1)[:, None], (docs ** 2).sum(1)[None, :]
    if metric == "cosine":
        return 1.0 - dots / np.maximum(np.sqrt(q2) * np.sqrt(d2), 1e-300)
    return np.maximum(q2 - 2 * dots + d2, 0.0)


def _first(query: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each query by (distance, id), over all queries at once."""
    order = np.lexsort((ids, dist, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


class _Nearest:
    """The k nearest rows seen so far per query and group: a state that takes batches and merges."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.state: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, groups: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for name in dict.fromkeys(groups.tolist()):
            own = groups == name
            dist = np.round(_distances(self.queries, vectors[own], self.metric), DIGITS)
            if self.k < dist.shape[1]:  # no row behind the k-th distance can be among the first k; ties stay
                query, at = np.nonzero(dist <= np.partition(dist, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            else:
                query, at = (x.ravel() for x in np.indices(dist.shape))
            found = query, dist[query, at], ids[own][at]
            if name in self.state:
                found = tuple(np.concatenate(x) for x in zip(self.state[name], found))
            keep = _first(*found, self.k)
            self.state[name] = tuple(x[keep] for x in found)

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": query_ids[q], "grp": name, "id": i, "distance": d}) for name, (q, d, i) in self.state.items()]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "grp", "id", "distance"])


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _vector_hits(docs: DataFrame, queries: DataFrame, function, schema: str, max_queries: int) -> DataFrame:
    """`function` of (query ids, query vectors, batches of documents) where each document meets each query once.

    A query set that a count shows to be small travels to every task and documents are not moved. A larger one
    meets the documents on a grid of tiles whose bytes are bounded, whatever the numbers of both.
    """
    queries = queries.select("query_id", "vector")
    if small_enough(queries, max_queries):
        rows = queries.collect()  # bounded by max_queries
        if not rows:
            return docs.sparkSession.createDataFrame([], schema)
        ids = np.array([r["query_id"] for r in rows])
        shared = docs.sparkSession.sparkContext.broadcast(np.array([r["vector"] for r in rows], dtype="float64"))
        return docs.mapInPandas(lambda batches: function(ids, shared.value, batches), schema)
    width = max(1, docs.agg(F.max(F.size("vector"))).first()[0] or 1)
    tile = max(1, TILE_BYTES // (8 * width))
    n_d, n_q = -(-docs.count() // tile), -(-queries.count() // min(tile, max_queries))
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    d = docs.withColumn("d_tile", F.pmod(F.xxhash64("id"), F.lit(max(n_d, 1))).cast("int")).withColumn("q_tile", cells(n_q))
    q = queries.withColumn("q_tile", F.pmod(F.xxhash64("query_id"), F.lit(max(n_q, 1))).cast("int")).withColumn("d_tile", cells(n_d))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return pd.concat(list(function(right["query_id"].to_numpy(), _stacked(right["vector"]), [left])))

    return d.groupBy("d_tile", "q_tile").cogroup(q.groupBy("d_tile", "q_tile")).applyInPandas(cell, schema)


def vector_search(docs: DataFrame, queries: DataFrame, k: int, metric: str = "l2", group: str | None = None,
                  max_queries: int = MAX_QUERIES) -> DataFrame:
    """Exact k nearest documents per query (and per group), smallest distance first.

    `docs` has (id, vector), `queries` has (query_id, vector); the distance is squared L2 or
    1 - cosine. Each task keeps k rows per query and group, whatever the corpus; the rows of all tasks
    are cut to k per task again before they meet.
    """
    docs = docs.select("id", "vector", (F.col(group).cast("string") if group else F.lit("")).alias("grp"))
    types = dict(docs.dtypes), dict(queries.dtypes)
    schema = f"query_id {types[1]['query_id']}, grp string, id {types[0]['id']}, distance double"

    def scan(ids, vectors, batches):
        best = _Nearest(vectors, k, metric)
        for pdf in batches:
            if len(pdf):
                best.add(pdf["grp"].to_numpy(), pdf["id"].to_numpy(), _stacked(pdf["vector"]))
        yield best.rows(ids)

    hits = _vector_hits(docs, queries, scan, schema, max_queries)
    order = Window.partitionBy("query_id", "grp").orderBy("distance", "id")
    out = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.withColumnRenamed("grp", group) if group else out.drop("grp")


def vector_distances(docs: DataFrame, queries: DataFrame, metric: str = "l2", max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, id, distance) of every document to every query, for whole rankings; batches stream through."""
    types = dict(docs.dtypes), dict(queries.dtypes)

    def scan(ids, vectors, batches):
        for pdf in batches:
            if len(pdf):
                dist = np.round(_distances(vectors, _stacked(pdf["vector"]), metric), DIGITS)
                yield pd.DataFrame({"query_id": np.repeat(ids, len(pdf)), "id": np.tile(pdf["id"].to_numpy(), len(ids)), "distance": dist.ravel()})

    return _vector_hits(docs.select("id", "vector"), queries, scan, f"query_id {types[1]['query_id']}, id {types[0]['id']}, distance double", max_queries)


def multi_search(docs: DataFrame, queries: DataFrame, k: int, collection: str, metric: str = "l2") -> DataFrame:
    """The k nearest of every collection per query."""
    return vector_search(docs, queries, k, metric, group=collection)


def compare_hits(docs: DataFrame, queries: DataFrame, left: str, right: str, system="system", k: int = 3) -> DataFrame:
    """The k nearest of each of two systems per query."""
    return vector_search(docs.filter(F.col(system).isin(left, right)), queries, k, group=system)


def ann_search(docs: DataFrame, queries: DataFrame, k: int, max_distance: float, bucket: float = 0.5,
               tables: int = 6, seed: int = 7) -> DataFrame:
    """Approximate nearest documents by random projections, refined by true distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    vec = lambda df: df.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket,
                                      numHashTables=tables, seed=seed)
    d = vec(docs.select("id", "vector"))
    model = lsh.fit(d)
    pairs = model.approxSimilarityJoin(d, vec(queries.select("query_id", "vector")), max_distance, "dist")
    rows = pairs.select(F.col("datasetB.query_id").alias("query_id"), F.col("datasetA.id").alias("id"),
                        (F.col("dist") * F.col("dist")).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class VectorIndex:
    """An approximate index kept as a table: documents in lists, each list around a centre.

    Centres come from k-means over a bounded sample; every document is stored with its nearest one. A search probes
    the lists whose centres are nearest to the query and compares by true distance there.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def build(self, docs: DataFrame, lists: int = 64, sample: int = 100_000, seed: int = 7) -> None:
        """`docs` has (id, vector). At most `sample` rows are fitted, all are stored; `lists` centres reach the driver."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        docs = docs.select("id", F.col("vector").cast("array<double>").alias("vector"))
        some = docs.orderBy(F.xxhash64("id")).limit(sample).select(array_to_vector("vector").alias("features"))
        centres = KMeans(k=lists, seed=seed, maxIter=20).fit(some).clusterCenters()
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "id int, vector array<double>").write.mode("overwrite").parquet(f"{self.folder}/centres")
        matrix = np.array(centres)

        def assigned(batches):
            for pdf in batches:
                nearest = _distances(_stacked(pdf["vector"]), matrix, "l2").argmin(axis=1) if len(pdf) else np.zeros(0, int)
                yield pdf.assign(list=nearest.astype("int32"))

        rows = docs.mapInPandas(assigned, f"id {dict(docs.dtypes)['id']}, vector array<double>, list int")
        rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{self.folder}/lists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/lists")

    def probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, list) of the lists to read."""
        return vector_search(self.spark.read.parquet(f"{self.folder}/centres"), queries, probes).select("query_id", F.col("id").alias("list"))

    def tune(self, queries: DataFrame, k: int, target: float = 0.95) -> int:
        """The least number of probes, in doubling steps, with which this sample of queries finds its share of the true k nearest.

        Vectors in clear groups need few lists; vectors without any structure need nearly all.
        """
        exact = cut_lineage(vector_search(self.rows().select("id", "vector"), queries, k).select("query_id", "id"))
        lists, asked, probes = self.spark.read.parquet(f"{self.folder}/centres").count(), exact.count(), 1
        while probes < lists and exact.join(self.search(queries, k, probes), ["query_id", "id"], "left_semi").count() < target * asked:
            probes *= 2
        return min(probes, lists)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, distance, rank): the k nearest among the probed lists."""
        asked = self.probes(queries, probes).join(queries.select("query_id", F.col("vector").cast("array<double>").alias("asked")), "query_id")
        near = F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        rows = self.rows().join(maybe_broadcast(asked), "list").select("query_id", "id", F.round(near, DIGITS).alias("distance"))
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


TOKEN = "[a-z0-9]+"


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(TOKEN), F.lit(0))


def token_count(text) -> Column:
    return F.regexp_count(F.lower(as_col(text)), F.lit(TOKEN))


TERMS = 500_000  # rows of (term, weight) that are broadcast


def vectorize(docs: DataFrame, text="text", key="id") -> DataFrame:
    """Normalised TF-IDF weights as rows (id, term, weight).

    Texts are dealt by id once, so the terms of a document are counted, weighted and normalised where it lies. Weights of
    up to `TERMS` terms are broadcast after a count; with more terms, counts meet them by term and go back to their document.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition("id")
    counts = rows.select("id", F.explode(tokens("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    idf = cut_lineage(df.join(F.broadcast(total)).select("term", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")))
    idf = F.broadcast(idf) if small_enough(idf, TERMS) else idf.hint("merge")
    raw = counts.filter("id IS NOT NULL").join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.withColumn("norm", norm).filter(F.col("norm") > 0).select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def hashed_vectors(docs: DataFrame, text="text", size: int = 4096) -> DataFrame:
    """Fixed-size normalised TF-IDF vectors, for nearest-vector search over texts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol="_idf"),
              Normalizer(inputCol="_idf", outputCol="vector")]
    with_tokens = docs.withColumn("_tokens", tokens(text))
    return Pipeline(stages=stages).fit(with_tokens).transform(with_tokens).drop("_tokens", "_tf", "_idf")


# --- Fixed values: BM25 and rank fusion ------------------------------------------------
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60


def _weights(tf: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, score) from (id, dl, term, tf) of the query terms, one row (n, avgdl) and (query_id, term)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats)).select(
        "term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (
        F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, "term").join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def bm25_scores(docs: DataFrame, queries: DataFrame, text="text") -> DataFrame:
    """(query_id, id, score) of all documents with a query term. Only tokens that occur in a query leave their document's row."""
    terms = _query_terms(queries)
    lengths = docs.select("id", tokens(text).alias("ts")).select("id", F.size("ts").alias("dl"), "ts")
    stats = docs.agg(F.count("*").alias("n"), F.avg(token_count(text)).alias("avgdl"))  # one row
    found = lengths.select("id", "dl", F.explode("ts").alias("term")).join(
        maybe_broadcast(terms.select("term").distinct()), "term")
    # query terms only, so far smaller than the texts; read twice
    return _weights(cut_lineage(found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))), stats, terms)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, text="text") -> DataFrame:
    """Top k documents per query by BM25. `docs` has (id, text), `queries` (query_id, text)."""
    return _best(bm25_scores(docs, queries, text), k)


class TextIndex:
    """An inverted index kept as tables: postings by term, and the current batch and length of every document.

    `add` writes a batch once; a document that comes again replaces its older text, as the newest batch decides.
    Postings lie in PARTS folders by a hash of the term and are sorted by term, so a search lists only the
    folders of its terms and reads the row groups that hold them. Lengths and counts come with the batches.
    """

    PARTS = 64

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def _part(self, term) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.PARTS)).cast("int")

    def add(self, docs: DataFrame, batch: int) -> None:
        """`docs` has (id, text); batches are numbered upward, and a repeated one overwrites itself. A null text is empty."""
        counted = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("ts")).select("id", F.size("ts").cast("bigint").alias("dl"), "ts")
        counted.select("id", "dl").write.mode("overwrite").parquet(f"{self.folder}/documents/batch={batch}")
        postings = counted.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        postings.withColumn("part", self._part(F.col("term"))).repartition("part", F.pmod(F.xxhash64("term"), F.lit(1 << 20)) % 4) \
            .sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings/batch={batch}")

    def documents(self) -> DataFrame:
        """(id, batch, dl) of the current text of every document."""
        rows = self.spark.read.parquet(f"{self.folder}/documents")
        return rows.groupBy("id").agg(F.max("batch").alias("batch"), F.max_by("dl", "batch").alias("dl"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(id, dl, term, tf) of the terms asked for (column `term`), current texts only."""
        wanted = terms.select("term").distinct()
        parts = [r["part"] for r in wanted.select(self._part(F.col("term")).alias("part")).distinct().collect()]  # PARTS numbers at most
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("part").isin(parts)).join(maybe_broadcast(wanted), "term")
        return rows.join(self.documents().select("id", "batch"), ["id", "batch"], "left_semi").select("id", "dl", "term", "tf")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score), the same as `bm25_scores` over the current texts."""
        terms = _query_terms(queries)
        stats = self.documents().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return _weights(cut_lineage(self.postings(terms)), stats, terms)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return _best(self.scores(queries), k)


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int, depth: int | None = None, index: TextIndex | None = None) -> DataFrame:
    """Text and vector rankings fused by reciprocal rank. Both sides have text and vector; `index` may hold the texts.

    None fuses the whole rankings, numbered over range partitions, so no task ranks all documents of a query;
    `depth` fuses only their first ranks, which can miss a document.
    """
    scores = bm25_scores(docs, queries) if index is None else index.scores(queries)
    if depth is None:
        by_text = number_rows(scores, [F.desc("score"), F.col("id")], ["query_id"], "rank")
        by_vector = number_rows(vector_distances(docs, queries), [F.col("distance"), F.col("id")], ["query_id"], "rank")
    else:
        by_text, by_vector = _best(scores, depth), vector_search(docs, queries, depth)
    fused = by_text.select("query_id", "id", "rank").unionByName(by_vector.select("query_id", "id", "rank")).groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return _best(fused, k)


def topk_per_group(hits: DataFrame, k: int, group: list[str], order: list) -> DataFrame:
    """First k rows per group; the row limit is applied per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build_context(hits: DataFrame, k: int, max_chars: int | None = None) -> DataFrame:
    """Context text of the top k hits per query, whole or cut to `max_chars`; three or more hits give high confidence."""
    top = hits.filter(F.col("rank") <= k)
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] Type: "), F.col("doc_type"), F.lit(" | System: "),
                    F.col("system"), F.lit("\nContent: "), F.col("content") if max_chars is None else F.left("content", F.lit(max_chars)), F.lit("\n---"))
    text = top.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda s: s["t"]), "\n").alias("context"))
    total = hits.groupBy("query_id").agg(F.count("*").alias("total_results"))
    return text.join(total, "query_id").withColumn(
        "confidence", F.when(F.col("total_results") >= 3, "high").otherwise("medium"))


def find_documents(docs: DataFrame, queries: DataFrame, k: int, doc_type: str, system: str | None = None) -> DataFrame:
    """Nearest documents of one type (process, sttm, gap), optionally of one system."""
    docs = docs.filter(F.col("doc_type") == doc_type)
    return vector_search(docs if system is None else docs.filter(F.col("system") == system), queries, k)


def merge_hits(chunk_hits: DataFrame, name_hits: DataFrame, pattern_hits: DataFrame) -> DataFrame:
    """Hits of several searches per file (path, score).

    Chunk hits keep the best score and count; name hits add files not yet found; a pattern
    hit on a found file blends to min(mean * 1.2, 1).
    """
    best = lambda df, name: df.groupBy("path").agg(F.max("score").alias(name))
    chunks = chunk_hits.groupBy("path").agg(F.max("score").alias("chunk"), F.count("*").alias("matched_chunks"))
    out = chunks.join(best(name_hits, "by_name"), "path", "full").join(best(pattern_hits, "by_pattern"), "path", "full")
    base = F.coalesce("chunk", "by_name")
    blended = F.least((base + F.col("by_pattern")) / 2 * 1.2, F.lit(1.0))
    score = F.when(base.isNull(), F.col("by_pattern")).when(F.col("by_pattern").isNull(), base).otherwise(blended)
    return out.select("path", score.alias("score"), F.coalesce("matched_chunks", F.lit(0)).alias("matched_chunks"))
