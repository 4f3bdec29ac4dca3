"""Nearest vectors and kept indexes against plain versions."""

import math
import random
import re

import numpy as np
import pytest

from estatelens.operators import search as se


def vector_rows(n=120, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(int(k), rng.integers(-3, 4, dim).astype(float).tolist(), "abc"[k % 3]) for k in range(n)]
    return rows + [(n + k, rows[5][1], "a") for k in range(6)]  # ties


@pytest.mark.parametrize("tile, max_queries", [(None, 4096), (400, 3)])
@pytest.mark.parametrize("k", [1, 4, 500])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equal_brute_force(spark, monkeypatch, metric, k, tile, max_queries):
    if tile:
        monkeypatch.setattr(se, "TILE_BYTES", tile)
    rows = vector_rows()
    queries = [(q, v) for q, (_, v, _) in enumerate(vector_rows(11, seed=3))]
    docs = spark.createDataFrame(rows, "id long, vector array<double>, kind string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id int, vector array<double>")
    got = {}
    for r in se.vector_search(docs, asked, k, metric, group="kind", max_queries=max_queries).collect():
        got.setdefault((r["query_id"], r["kind"]), []).append((r["rank"], r["id"], r["distance"]))

    def far(a, b):
        a, b = np.array(a), np.array(b)
        value = ((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / max(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()), 1e-300)
        return round(float(value), 9) + 0.0

    for q, v in queries:
        for kind in "abc":
            want = sorted((far(v, w), i) for i, w, g in rows if g == kind)[:k]
            own = sorted(got[q, kind])
            assert [d for _, _, d in own] == pytest.approx([d for d, _ in want], abs=1e-8)
            if metric == "l2":
                assert [i for _, i, _ in own] == [i for _, i in want]
    if k == 4:
        whole = se.vector_distances(docs, asked, metric, max_queries).collect()
        assert len(whole) == len(rows) * len(queries) == len({(r["query_id"], r["id"]) for r in whole})


def test_text_index_follows_the_newest_batch(spark, tmp_path):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "x1", "y2"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(0, 12)))
    first = {k: text() for k in range(40)}
    second = {k: text() for k in range(30, 60)} | {35: "", 36: None}
    index = se.TextIndex(spark, str(tmp_path / "index"))
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    index.add(frame(first), 1)
    index.add(frame(second), 2)
    index.add(frame(second), 2)  # a repeated batch changes nothing
    texts = {k: re.findall("[a-z0-9]+", (v or "").lower()) for k, v in (first | second).items()}
    queries = {1: ["alpha", "x1"], 2: ["gamma"], 3: ["nowhere"]}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    want = {}
    for q, terms in queries.items():
        for k, ts in texts.items():
            parts = []
            for t in terms:
                df = sum(t in x for x in texts.values())
                if t in ts:
                    tf = ts.count(t)
                    parts.append(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean)))
            if parts:
                want[q, k] = sum(parts)
    asked = spark.createDataFrame([(q, " ".join(t)) for q, t in queries.items()], "query_id int, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in index.scores(asked).collect()}
    assert sorted(got) == sorted(want)
    assert {k: got[k] for k in want} == pytest.approx(want, abs=2e-6)
    assert [r["rank"] for r in index.search(asked, 3).where("query_id = 2").orderBy("rank").collect()] == [1, 2, 3]


def test_a_vector_index_finds_grouped_vectors_in_few_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 20
    rows = [(k, (centres[k % 12] + rng.normal(size=8)).tolist()) for k in range(600)]
    docs = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = spark.createDataFrame([(q, (centres[q] + 0.1).tolist()) for q in range(12)], "query_id int, vector array<double>")
    index = se.VectorIndex(spark, str(tmp_path / "vectors"))
    index.build(docs, lists=12)
    probes = index.tune(queries, 5)
    assert probes <= 2 and index.rows().count() == 600
    exact = {(r["query_id"], r["id"]) for r in se.vector_search(docs, queries, 5).collect()}
    found = {(r["query_id"], r["id"]) for r in index.search(queries, 5, probes).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(r["query_id"], r["id"]) for r in index.search(queries, 5, 12).collect()} == exact
