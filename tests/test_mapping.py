"""Workflow mapping: hand-computed anchor, and both layers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import workflow_mapping as wm

SCHEMA = ("system string, name string, path string, source_tables array<string>, target_tables array<string>, "
          "transformation_types array<string>, business_keywords array<string>")


def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def brute(rows, threshold=0.3):
    out = {}
    for s in (r for r in rows if r[0] == "hadoop"):
        for t in (r for r in rows if r[0] == "databricks"):
            d = (jac(s[3], t[3]) + jac(s[4], t[4])) / 2
            l, b = jac(s[5], t[5]), jac(s[6], t[6])
            o = round(.5 * d + .3 * l + .2 * b, 9)
            if o >= threshold:
                out[s[1], t[1]] = (d, l, b, o)
    return out


def brute_mappings(pairs):
    by_t, by_s = {}, {}
    for (s, t), v in pairs.items():
        by_t.setdefault(t, {})[s] = v
        by_s.setdefault(s, {})[t] = v
    rows, used = {}, set()
    mean = lambda vs: tuple(round(sum(v[i] for v in vs) / len(vs), 6) for i in range(4))
    for t, ss in by_t.items():
        if len(ss) > 1:
            rows["N:1", t] = (len(ss), 1) + mean(list(ss.values()))
            used |= set(ss)
    for s, ts in by_s.items():
        if s not in used:
            rows["1:N" if len(ts) > 1 else "1:1", s] = (1, len(ts)) + mean(list(ts.values()))
    return rows


def estate(n, hot, seed):
    """Workflows of two systems where one table is read and one written by a third of all."""
    r = random.Random(seed)
    rows = []
    for system, mark in (("hadoop", "h"), ("databricks", "d")):
        for i in range(n):
            src = {f"s{r.randrange(n)}" for _ in range(r.randrange(3))}
            tgt = {f"t{r.randrange(n)}" for _ in range(r.randrange(2))}
            if hot and r.random() < .34:
                src.add("hot_in")
            if hot and r.random() < .34:
                tgt.add("hot_out")
            kinds = r.sample(["filter", "group_by", "join"], r.randrange(3))
            words = r.sample(["claim", "patient"], r.randrange(2))
            rows.append((system, f"{mark}{i}", f"/{mark}{i}", sorted(src), sorted(tgt), sorted(kinds), sorted(words)))
    return rows


def test_anchor(spark):
    rows = [
        ("hadoop", "a", "/a", ["x", "y"], ["out"], ["filter", "join"], ["claim", "patient"]),
        ("hadoop", "b", "/b", ["p"], ["q"], ["filter", "join"], ["claim"]),
        ("databricks", "c", "/c", ["x", "y"], ["out"], ["filter", "join"], ["claim", "patient"]),
    ]
    sigs = spark.createDataFrame(rows, SCHEMA)
    m = wm.group_mappings(sigs, "hadoop", "databricks")
    got = wm.mapping_table(m, sigs, "hadoop", "databricks").collect()
    assert len(got) == 1
    row = got[0]
    assert (row["kind"], row["anchor"], row["n_sources"], row["n_targets"]) == ("N:1", "c", 2, 1)
    assert row["overall_sim"] == pytest.approx((1.0 + 0.4) / 2) and row["confidence"] == "high"
    report = wm.migration_report(m, sigs, "hadoop", "databricks").collect()[0]
    assert report["completeness"] == 100.0 and report["unmapped_sources"] == 0


@pytest.mark.parametrize("hot_limit", [0, 1, 3, 1000])
@pytest.mark.parametrize("hot", [False, True])
def test_layers_equal_brute_force(spark, hot, hot_limit):
    rows = estate(40, hot, seed=hot_limit + 17 * hot)
    sigs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    table = wm.PairTable(sigs, "hadoop", "databricks", hot_limit=hot_limit)
    groups = table.groups().collect()
    assert sum(g["n_pairs"] for g in groups) == len(want)
    key = lambda v: tuple(round(x, 6) for x in v)
    hist, got = {}, {}
    for v in want.values():
        hist[key(v)] = hist.get(key(v), 0) + 1
    for g in groups:
        k = key((g["data_sim"], g["logic_sim"], g["business_sim"], g["overall_sim"]))
        got[k] = got.get(k, 0) + g["n_pairs"]
    assert got == hist
    m = wm.Mappings(table)
    rows_got = {(r["kind"], r["anchor"]): (r["n_sources"], r["n_targets"], *(round(r[c], 6) for c in wm.SIMS))
                for r in wm.mapping_table(m, sigs, "hadoop", "databricks").collect()}
    assert_close(rows_got, brute_mappings(want))


def assert_close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=2e-6), k


@pytest.mark.parametrize("hot_limit", [1, 1000])
def test_table_diff_equals_brute_force(spark, hot_limit):
    rows = estate(30, True, seed=5)
    sigs = spark.createDataFrame(rows, SCHEMA)
    info = {r[1]: r for r in rows}
    pairs = brute(rows)
    want = set()
    for (kind, anchor), v in brute_mappings(pairs).items():
        if kind == "N:1":
            outs = set().union(*[info[s][4] for s, t in pairs if t == anchor])
            t_in, t_out = set(info[anchor][3]), set(info[anchor][4])
            parts = (outs & t_in, outs - t_out, t_out - outs)
        else:
            ts = [t for s, t in pairs if s == anchor]
            t_in = set().union(*[info[t][3] for t in ts])
            t_out = set().union(*[info[t][4] for t in ts])
            parts = (set(info[anchor][3]) & t_in, set(info[anchor][4]) - t_out, t_out - set(info[anchor][4]))
        for rel, tabs in zip(("shared", "missing", "added"), parts):
            want |= {(kind, anchor, t, rel) for t in tabs}
    m = wm.group_mappings(sigs, "hadoop", "databricks", hot_limit=hot_limit)
    names = wm.members(sigs, "hadoop").unionByName(wm.members(sigs, "databricks")).select(F.col("key").alias("anchor_key"), "name")
    diff = m.table_diff().unionByName(m.expand_missing(m.rows().select(F.col("target_key").alias("anchor_key"))))
    got = {(r["kind"], r["name"], r["tab"], r["relation"]) for r in diff.join(names, "anchor_key").collect()}
    # a source and a target can have equal signatures: keep the anchors of each kind only
    maps = brute_mappings(pairs)
    got = {g for g in got if (g[0], g[1]) in maps}
    assert got == want
    counts = {(r["kind"], r["name"]): (r["n_shared"], r["n_missing"], r["n_added"])
              for r in m.table_counts().join(names, "anchor_key").collect() if (r["kind"], r["name"]) in maps}
    number = lambda key, rel: sum(1 for w in want if w[:2] == key and w[3] == rel)
    assert counts == {k: tuple(number(k, r) for r in ("shared", "missing", "added")) for k in maps}
    assert {r["tab"] for r in m.missing_tables().collect()} == {w[2] for w in want if w[3] == "missing"}


@pytest.mark.parametrize("text", ["h1", "d2", "3"])
def test_mappings_for_equals_brute_force(spark, text):
    rows = estate(30, True, seed=9)
    sigs = spark.createDataFrame(rows, SCHEMA)
    pairs = brute(rows)
    maps = brute_mappings(pairs)
    want = set()
    for (kind, anchor) in maps:
        sources = {s for s, t in pairs if t == anchor} if kind == "N:1" else {anchor}
        targets = {anchor} if kind == "N:1" else {t for s, t in pairs if s == anchor}
        want |= {(kind, anchor, "source") for s in sources if text in s}
        want |= {(kind, anchor, "target") for t in targets if text in t}
    m = wm.group_mappings(sigs, "hadoop", "databricks", hot_limit=2)
    got = {(r["kind"], r["anchor"], r["matched_side"])
           for r in wm.mappings_for(m, sigs, "hadoop", "databricks", text).collect()}
    assert got == want


def test_logic_similarity_boost_and_cap(spark):
    df = spark.createDataFrame(
        [(["filter"], ["where_clause"], ["a"], ["a"], [], []), (["join"], ["join"], ["a"], ["a"], ["r"], ["r"]), ([], [], [], [], [], [])],
        "s_transformations array<string>, t_transformations array<string>, s_tables array<string>, t_tables array<string>, s_rules array<string>, t_rules array<string>")
    got = [r["logic_score"] for r in wm.logic_similarity(df).collect()]
    assert got == pytest.approx([0.3 / 0.7 + 0.2, 1.0, 0.0])


def test_no_row_depends_on_the_hot_limit(spark):
    sigs = spark.createDataFrame(estate(40, True, seed=3), SCHEMA)
    rows = [sorted(map(tuple, wm.pair_similarity(sigs, "hadoop", "databricks", hot_limit=n).collect())) for n in (0, 2, 1000)]
    assert rows[0] == rows[1] == rows[2]


def test_missing_tables_keep_columns_of_their_anchors(spark):
    rows = [("hadoop", f"s{i}", "p", [f"a{i}"], [f"x{i}"], ["join"], ["patient"]) for i in range(3)] \
        + [("databricks", f"t{i}", "p", [f"b{i}"], ["x1"] if i else [], ["join"], ["patient"]) for i in range(2)]
    m = wm.group_mappings(spark.createDataFrame(rows, SCHEMA), "hadoop", "databricks")
    keys = m.rows().filter("kind = 'N:1'").select(F.col("target_key").alias("anchor_key"))
    named = keys.withColumn("note", F.lit("one")).unionByName(keys.withColumn("note", F.lit("two")))
    plain = {(r["anchor_key"], r["tab"]) for r in m.expand_missing(keys).collect()}
    assert sorted(t for _, t in plain) == ["x0", "x0", "x1", "x2", "x2"]
    kept = m.expand_missing(named, keep=("note",))
    assert {(r["anchor_key"], r["tab"], r["note"]) for r in kept.collect()} == {(k, t, n) for k, t in plain for n in ("one", "two")}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "t_key" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin [t_key#" in line]
