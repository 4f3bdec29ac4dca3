"""Matching of processes: blocks and joins against brute force, at thresholds with and without shared tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from estatelens.operators import grids
from estatelens.operators import matching as mt

WORDS = ["lead", "coverage", "gmrn", "patient", "cdd", "edi", "demographics", "matching"]


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def estate(dense, seed):
    """Processes with own tables, functions and descriptions, and components of few types."""
    r = random.Random(seed)
    names = ["load_lead", "Load_Lead", "lead", "patient_match_daily", "match", "x", "coverage_load"] + [f"job_{k}" for k in range(8)]
    processes, components = [], []
    for k in range(70):
        tables = {f"t{i}" for i in range(20) if r.random() < 0.9} if dense else {f"t{r.randrange(300)}" for _ in range(r.randrange(4))}
        text = r.choice(["", None, "other", " ".join(r.sample(WORDS, r.randrange(1, 4)))])
        processes.append((f"p{k:02d}", "hadoop" if k % 2 else "databricks", r.choice(names), text, r.choice(["", None, "patient things"]), sorted(tables), ["/in/A.csv"] if r.random() < 0.2 else None))
        for kind in r.sample(["source", "filter", "join", "sink"], r.randrange(4)):
            components += [(f"p{k:02d}", kind, "a", "b")] * r.randrange(1, 5)
    return processes, components


def brute(processes, components, threshold):
    out = {}
    info = {}
    for pid, system, name, function, description, own, extra in processes:
        text = (function or description or "").lower()
        counts = {}
        for p, kind, _, _ in components:
            if p == pid:
                counts[kind] = counts.get(kind, 0) + 1
        info[pid] = system, name.lower(), text, {w for w in WORDS if w in text}, set(own) | ({"a"} if extra else set()), counts
    for s, (system, name, text, words, tables, counts) in info.items():
        if system != "hadoop":
            continue
        for t, (system2, name2, text2, words2, tables2, counts2) in sorted(info.items()):
            if system2 != "databricks":
                continue
            n = 1.0 if name == name2 else 0.8 if name in name2 or name2 in name else jac(set(name.split("_")), set(name2.split("_")))
            d = 0.0 if not text or not text2 else 0.5 if not words and not words2 else jac(words, words2)
            kinds = set(counts) | set(counts2)
            c = sum(1 - abs(counts.get(k, 0) - counts2.get(k, 0)) / max(counts.get(k, 0), counts2.get(k, 0), 1) for k in kinds) / len(kinds) if counts and counts2 else 0.0
            score = round(0.2 * n + 0.4 * jac(tables, tables2) + 0.2 * d + 0.2 * c, 9)
            if score >= threshold and (s not in out or score > out[s][1]):
                out[s] = t, score
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.62, 0.7])
@pytest.mark.parametrize("dense", [False, True])
def test_best_processes_equal_brute_force(spark, monkeypatch, dense, threshold):
    processes, components = estate(dense, seed=4)
    monkeypatch.setattr(mt, "grid", lambda a, b, f, schema, block: grids.grid(a, b, f, schema, 13))
    p = spark.createDataFrame(processes, "process_id string, system string, name string, business_function string, description string, "
                                         "tables_involved array<string>, input_sources array<string>")
    c = spark.createDataFrame(components, "process_id string, component_type string, input_dataset string, output_dataset string")
    got = {r["source_id"]: (r["target_id"], r["score"]) for r in mt.match_processes(p, c, "hadoop", "databricks", threshold).collect()}
    want = brute(processes, components, threshold)
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert mt.match_processes(p.limit(0), c.limit(0), "hadoop", "databricks", threshold).collect() == []


@pytest.mark.parametrize("pays", [0, 10 ** 9])
def test_overlaps_do_not_depend_on_the_way(spark, monkeypatch, pays):
    """A join for `pays` of 0, a grid for a large one."""
    processes, _ = estate(True, seed=5)
    monkeypatch.setattr(mt, "PAYS", pays)
    rows = [(p[0], p[5]) for p in processes] + [("none", [])]
    df = spark.createDataFrame(rows, "key string, tables array<string>")
    sets = {k: set(t) for k, t in rows}
    want = {(a, b): jac(sets[a], sets[b]) for a in sets for b in sets if sets[a] & sets[b] and round(jac(sets[a], sets[b]), 9) >= 0.8}
    got = {(r["left_key"], r["right_key"]): r["table_score"] for r in mt.table_overlaps(df, df, 0.8).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {r["left_key"]: (r["right_key"], round(r["table_score"], 9), r["matches"]) for r in mt.best_overlaps(df, df, 0.8).collect()}
    for a in {x for x, _ in want}:
        top = max((round(v, 9), len(b), b) for (x, b), v in want.items() if x == a)
        assert best[a] == (top[2], top[0], sum(x == a for x, _ in want))
    assert len(best) == len({x for x, _ in want})


def test_shared_members_with_common_and_rare_ones():
    r = random.Random(1)
    sets = [[sorted(r.sample(range(40), r.randrange(9)) + [100 + r.randrange(500) for _ in range(r.randrange(3))]) for _ in range(30)] for _ in range(2)]
    sets = [[sorted(set(x)) for x in side] for side in sets]
    flat = [grids.lists(pa.chunked_array([pa.array(side, pa.list_(pa.int64()))])) for side in sets]
    want = np.array([[len(set(a) & set(b)) for b in sets[1]] for a in sets[0]])
    assert (grids.shared(*flat, 30, 30) == want).all()
    assert (grids.shared((flat[0][0][:0], flat[0][1][:0]), flat[1], 30, 30) == 0).all()


def test_pairs_of_one_hot_key_are_spread_over_tasks(spark):
    from estatelens.functions.scale import join_spread
    left = spark.createDataFrame([("a", i, {"x": i}) for i in range(300)] + [("b", 1000, None), (None, 1001, None)], "k string, i int, m map<string,int>")
    right = spark.createDataFrame([("a", j) for j in range(20)] + [("b", 7), ("b", 7), ("c", 8), (None, 9)], "k string, j int")
    got = join_spread(left, right, ["k"], block=10).select("k", "i", "j", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["k"], r["i"], r["j"]) for r in got) == sorted([("a", i, j) for i in range(300) for j in range(20)] + [("b", 1000, 7)] * 2)
    assert len({r["task"] for r in got}) > 8


def test_words_and_tokens_found_before_the_pairing_give_the_same_scores(spark):
    from estatelens.functions import sets, vocab
    from estatelens.functions.text import contained_words
    words = [*vocab.FUNCTION_KEYWORDS[:2], "other", None]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "l string, r string")
    for c in "lr":
        rows = rows.withColumn(f"{c}w", contained_words(c, vocab.FUNCTION_KEYWORDS)).withColumn(f"{c}t", sets.name_tokens(c))
    late = mt.name_pairs(mt.domain_pairs(rows, "l", "r"), "l", "r").collect()
    early = mt.name_pairs(mt.domain_pairs(rows, "lw", "rw"), "l", "r", "lt", "rt").collect()
    assert late == early


def test_all_blocks_meet_when_shuffles_keep_their_tasks(spark, monkeypatch):
    """Keys of the two sides had different types, so blocks only met where all of a shuffle was brought to one task."""
    processes, components = estate(True, seed=6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for module, name, value in ((grids, "CHUNK_BYTES", 1500), (grids, "TASK_ROWS", 4), (mt, "TILE", 3)):
        monkeypatch.setattr(module, name, value, raising=False)
    monkeypatch.setattr(mt, "grid", lambda a, b, f, schema, block=5: grids.grid(a, b, f, schema, 5))
    try:
        p = spark.createDataFrame(processes, "process_id string, system string, name string, business_function string, description string, "
                                             "tables_involved array<string>, input_sources array<string>")
        c = spark.createDataFrame(components, "process_id string, component_type string, input_dataset string, output_dataset string")
        found = mt.match_processes(p, c, "hadoop", "databricks", 0.5)
        got = {r["source_id"]: (r["target_id"], r["score"]) for r in found.collect()}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(processes, components, 0.5)
    assert got.keys() == want.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert "Union" in plan  # several chunks
