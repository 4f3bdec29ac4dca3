"""Hand-computed anchors and small fixtures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from estatelens.functions import scale, sets
from estatelens.functions import text as tx
from estatelens.operators import documents as dc
from estatelens.operators import graphs as gr
from estatelens.operators import jobs as jb
from estatelens.operators import lineage as ln
from estatelens.operators import matching as mt
from estatelens.operators import notebooks as nb
from estatelens.operators import oozie as oz
from estatelens.operators import pig_scripts as pig
from estatelens.operators import search as se
from estatelens.operators import sizing as sz
from estatelens.operators import sql_scripts as sq
from estatelens.operators import sttm as st
from estatelens.sources import files as src
from estatelens.sources import sinks
from estatelens.streaming import incremental as inc


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def first(df, c):
    return df.select(c).collect()[0][0]


@pytest.mark.parametrize("a,b,score", [("load_claims", "LOAD_CLAIMS", 1.0), ("load", "load_claims", .8), ("load_claims", "claims_daily", 1 / 3)])
def test_name_similarity(spark, a, b, score):
    assert first(one(spark, a=a, b=b), sets.name_similarity("a", "b")) == pytest.approx(score)


@pytest.mark.parametrize("raw,clean", [("/data/In/Claims.parquet", "claims"), ("db.claims", "db"), ("Claims", "claims")])
def test_clean_table(spark, raw, clean):
    assert first(one(spark, t=raw), tx.clean_table("t")) == clean


def test_keyword_similarity_neutral(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(sets.keyword_similarity("a", "b")).collect()] == [.5, 0.0, .5]


def test_effort_anchor(spark):
    row = sz.estimate_effort(one(spark, scripts=3, loc=500, actions=4, tables=2)).collect()[0]
    assert row["size_class"] == "Medium" and row["effort_days"] == 2.0 and row["effort_hours"] == 16.0
    assert row["effort_text"] == "2 days (16 hours)"
    assert (row["discovery_hours"], row["mapping_hours"], row["validation_hours"]) == (2.8, 3.6, 1.9)


@pytest.mark.parametrize("days,text", [(.5, "4 hours"), (1.0, "1 day (8 hours)"), (1.5, "1.5 day (12 hours)"), (2.5, "2.5 days (20 hours)")])
def test_effort_text(spark, days, text):
    assert first(one(spark, h=days * 8, d=days), tx.effort_text("h", "d")) == text


# --- lineage ------------------------------------------------------------------------------

CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]


@pytest.mark.parametrize("partitions", [1, 5])
def test_reach_in_a_cycle(spark, partitions):
    edges = spark.createDataFrame(CYCLE, "src string, dst string").repartition(partitions)
    start = one(spark, node="a")
    full = {(r["node"], r["depth"]) for r in ln.reach(edges, start).collect()}
    assert full == {("b", 1), ("c", 2), ("d", 3)}
    assert {r["node"] for r in ln.reach(edges, start, max_depth=2).collect()} == {"b", "c"}
    assert {r["node"] for r in ln.reach(edges, one(spark, node="d"), "upstream").collect()} == {"a", "b", "c"}


def test_topo_layers_reports_cycles(spark):
    edges = spark.createDataFrame(CYCLE + [("x", "a"), ("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    got = {r["node"]: r["layer"] for r in ln.topo_layers(edges).collect()}
    assert got == {"x": 0, "y": 1, "z": 2, "a": None, "b": None, "c": None, "d": None}


def plain_layers(pairs):
    """Longest way to each node, None on or behind a cycle."""
    before, nodes, layers = {}, {n for p in pairs for n in p}, {}
    for a, b in set(pairs):
        before.setdefault(b, set()).add(a)
    while True:
        free = [n for n in nodes if n not in layers and all(p in layers for p in before.get(n, ()))]
        if not free:
            return {n: layers.get(n) for n in nodes}
        for n in free:
            layers[n] = max((layers[p] + 1 for p in before.get(n, ())), default=0)


@pytest.mark.parametrize("seed", range(4))
def test_topo_layers_equal_a_plain_version(spark, seed):
    pick = random.Random(seed)
    size = 40
    forward = [tuple(sorted(pick.sample(range(size), 2))) for _ in range(pick.choice([25, 45, 90]))]
    back = [(b, a) for a, b in pick.sample(forward, seed)] + [(7, 7)] * (seed % 2)
    pairs = [(str(a), str(b)) for a, b in forward + back + forward[:5]]
    got = {r["node"]: r["layer"] for r in ln.topo_layers(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == plain_layers(pairs)


def test_topo_layers_of_a_long_chain_and_a_pure_cycle(spark):
    chain = [(f"n{k:05}", f"n{k + 1:05}") for k in range(2000)]
    ways = [("n00010", "m"), ("n01500", "m"), ("m", "after"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "behind"), ("r1", "both"), ("n00001", "both")]
    got = {r["node"]: r["layer"] for r in ln.topo_layers(spark.createDataFrame(chain + ways, "src string, dst string")).collect()}
    assert [got[f"n{k:05}"] for k in range(2001)] == list(range(2001))
    assert (got["m"], got["after"]) == (1501, 1502) and {got[n] for n in ("r1", "r2", "r3", "behind", "both")} == {None}
    assert ln.topo_layers(spark.createDataFrame([], "src string, dst string")).collect() == []


def layers_of(spark, pairs, **options):
    return {r["node"]: r["layer"] for r in ln.topo_layers(spark.createDataFrame(pairs, "src string, dst string"), **options).collect()}


def test_topo_layers_of_a_shallow_graph_contract_no_chains(spark, monkeypatch):
    """Four layers with chains in them are peeled as they are."""
    pick = random.Random(5)
    pairs = [(f"c{k % 5}", f"o{k}") for k in range(20)] + [(f"o{k}", f"p{pick.randrange(9)}") for k in range(20)] + [(f"p{k}", f"s{k % 4}") for k in range(9)] * 2
    monkeypatch.setattr(ln, "chain_ends", lambda parents: pytest.fail("contracted"))
    assert layers_of(spark, pairs) == plain_layers(pairs)


@pytest.mark.parametrize("plain_rounds", [0, 1, 3])
def test_topo_layers_whether_peeled_or_contracted(spark, plain_rounds):
    pick = random.Random(plain_rounds)
    forward = [tuple(sorted(pick.sample(range(60), 2))) for _ in range(75)] + [(k, k + 1) for k in range(30, 45)]
    pairs = [(str(a), str(b)) for a, b in forward] + [("59", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "end"), ("3", "end")]
    got = layers_of(spark, pairs, plain_rounds=plain_rounds)
    assert got == plain_layers(pairs) and max(n for n in got.values() if n is not None) > 6 and got["end"] is None


def test_topo_layers_with_nulls(spark):
    """What follows an unknown node has no layer, nor has the unknown node."""
    pairs = [("a", "b"), ("b", None), (None, "c"), ("a", "c"), ("c", "d"), (None, "e"), ("b", "f")]
    for rounds in (0, 4):
        assert layers_of(spark, pairs, plain_rounds=rounds) == {"a": 0, "b": 1, "f": 2, None: None, "c": None, "d": None, "e": None}


def plain_facts(links, io):
    """Facts per workflow: its own and those of all that is nested in it, at any depth."""
    known = set(io)
    while True:
        more = {(p, d, s) for p, c in links for w, d, s in known if w == c} - known
        if not more:
            return known
        known |= more


@pytest.mark.parametrize("seed", range(3))
def test_nested_io_equals_a_plain_version(spark, seed):
    """Ways of different length to one workflow, datasets held at several levels, links and rows that come twice, cycles."""
    pick = random.Random(seed)
    forward = [tuple(sorted(pick.sample(range(14), 2))) for _ in range(18)]
    links = [(f"w{a}", f"w{b}") for a, b in forward + [(b, a) for a, b in forward[:seed]] + [(3, 3)] * (seed == 2)] * 2
    io = [(f"w{pick.randrange(16)}", pick.choice(["input", "output"]), f"d{pick.randrange(4)}") for _ in range(20)] * 2
    got = ln.nested_io(spark.createDataFrame(links, "parent string, child string"), spark.createDataFrame(io, "workflow string, direction string, dataset string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_facts(set(links), io)


def test_nested_io_without_links_facts_or_names(spark):
    links = lambda rows: spark.createDataFrame(rows, "parent string, child string")
    io = lambda rows: spark.createDataFrame(rows, "workflow string, direction string, dataset string")
    assert ln.nested_io(links([("a", "b")]), io([])).collect() == []
    assert [tuple(r) for r in ln.nested_io(links([]), io([("a", "input", "x")] * 2)).collect()] == [("a", "input", "x")]
    rows = ln.nested_io(links([("a", "b"), ("b", "c"), (None, "c"), ("a", None)]), io([("c", "input", "x"), (None, "input", "y")])).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(w, "input", "x") for w in ("a", "b", "c", None)] + [(None, "input", "y")], key=str)


def test_trace_edges_do_not_multiply(spark):
    many = [("hub", f"in{k}") for k in range(300)] + [("next", "out7")]
    reads = spark.createDataFrame(many, "script string, tab string")
    writes = spark.createDataFrame([("hub", f"out{k}") for k in range(200)] + [("next", "end"), ("far", "away")], "script string, tab string")
    rows = ln.trace_edges(reads, writes, one(spark, tab="in0"))
    assert rows.count() == 300 + 200 + 2
    pairs = {tuple(r) for r in ln.hop_pairs(rows, one(spark, script="next")).collect()}
    assert pairs == {(2, "next", "out7", "end")}
    assert ln.hop_pairs(rows).count() == 300 * 200 + 1
    assert {tuple(r) for r in ln.hop_pairs(rows).collect()} == {tuple(r) for r in ln.trace_table(reads, writes, one(spark, tab="in0")).collect()}


def test_trace_table_visits_scripts_once(spark):
    reads = spark.createDataFrame([("s1", "a"), ("s1", "k"), ("s2", "b"), ("s3", "c")], "script string, tab string")
    writes = spark.createDataFrame([("s1", "b"), ("s2", "c"), ("s3", "a")], "script string, tab string")
    got = {tuple(r) for r in ln.trace_table(reads, writes, one(spark, tab="a")).collect()}
    assert got == {(1, "s1", "a", "b"), (1, "s1", "k", "b"), (2, "s2", "b", "c"), (3, "s3", "c", "a")}
    assert ln.trace_table(reads, writes, one(spark, tab="nothing")).count() == 0


def test_nested_io_moves_up(spark):
    parents = spark.createDataFrame([("w1", "w2"), ("w2", "w3")], "parent string, child string")
    io = spark.createDataFrame([("w3", "input", "t"), ("w1", "output", "o")], "workflow string, direction string, dataset string")
    got = {tuple(r) for r in ln.nested_io(parents, io).collect()}
    assert got == {("w3", "input", "t"), ("w2", "input", "t"), ("w1", "input", "t"), ("w1", "output", "o")}


# --- scale helpers --------------------------------------------------------------------------

def test_number_rows_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("v"))
    got = scale.number_rows(df, ["v"], ["g"])
    want = df.selectExpr("*", "CAST(row_number() OVER (PARTITION BY g ORDER BY v) AS BIGINT) AS row_number")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    total = scale.number_rows(df, ["v"]).agg(F.min("row_number"), F.max("row_number"), F.countDistinct("row_number")).collect()[0]
    assert tuple(total) == (1, 5000, 5000)


@pytest.mark.parametrize("span", [3, 10, 1000])
def test_forward_fill_across_spans(spark, span):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("p"),
                                 F.when(F.col("id") % 17 == 3, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("x"))
    got = scale.forward_fill(df, ["g"], "p", ["x"], span)
    want = df.selectExpr("g", "p", "last(x, true) OVER (PARTITION BY g ORDER BY p) AS x")
    assert got.exceptAll(want).count() == 0 and got.count() == 200


def test_containing_names(spark):
    refs = spark.createDataFrame([("sand/gr_12",), ("gr",), ("none",), ("x.gr_7.mp",)], "ref string")
    names = spark.createDataFrame([("gr_1",), ("gr_12",), ("gr_7",)], "name string")
    got = {tuple(r) for r in mt.containing_names(refs, names).collect()}
    assert got == {("sand/gr_12", "gr_1"), ("gr", "gr_1"), ("x.gr_7.mp", "gr_7")}


def test_equivalent_component_order_of_rules(spark):
    schema = "component_id string, process_id string, name string, datasets array<string>"
    source = spark.createDataFrame([("a", "p", "Load", ["x"]), ("b", "p", "load_all", []), ("c", "p", "other", ["k"]), ("d", "p", "zzz", [])], schema)
    target = spark.createDataFrame([("1", "q", "stage_load", ["k"]), ("2", "q", "LOAD", ["k", "x"])], schema)
    pairs = spark.createDataFrame([("p", "q")], "source_process string, target_process string")
    got = {tuple(r) for r in mt.equivalent_component(pairs, source, target).collect()}
    assert got == {("a", "2", 1), ("b", "2", 2), ("c", "1", 3)}


def test_process_match_equals_brute_force(spark):
    """Blocking on shared tables loses no pair above the threshold."""
    import random
    r = random.Random(3)
    names = [f"{w}_{i % 7}" for i, w in enumerate(["load", "stage", "load_claims", "mart"] * 8)]
    procs = [(f"p{i:02d}", "hadoop" if i % 2 else "databricks", n, r.choice(["patient", "lead coverage", "x"])) for i, n in enumerate(names)]
    comps = [(p[0], r.choice("AB"), "hot", f"t{r.randrange(5)}") for p in procs for _ in range(r.randrange(1, 4))]
    processes = spark.createDataFrame(procs, "process_id string, system string, name string, business_function string")
    components = spark.createDataFrame(comps, "process_id string, component_type string, input_dataset string, output_dataset string")
    profiles = mt.process_profiles(processes, components).collect()
    got = {tuple(x) for x in mt.match_processes(processes, components, "hadoop", "databricks").select("source_id", "target_id").collect()}

    def jac(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0

    def score(a, b):
        x, y = a["name"], b["name"]
        name = 1 if x == y else .8 if x in y or y in x else jac(x.split("_"), y.split("_"))
        da, db = a["domains"], b["domains"]
        dom = .5 if not da and not db else 0 if not da or not db else jac(da, db)
        ca, cb = ({t["component_type"]: t["n"] for t in p["type_counts"]} for p in (a, b))
        kinds = set(ca) | set(cb)
        comp = sum(1 - abs(ca.get(k, 0) - cb.get(k, 0)) / max(ca.get(k, 0), cb.get(k, 0), 1) for k in kinds) / len(kinds)
        return round(.2 * name + .4 * jac(a["tables"], b["tables"]) + .2 * dom + .2 * comp, 9)

    want = set()
    for a in (p for p in profiles if p["system"] == "hadoop"):
        best = min(((-score(a, b), b["process_id"]) for b in profiles if b["system"] == "databricks"), default=(0, ""))
        if -best[0] >= .7:
            want.add((a["process_id"], best[1]))
    assert got == want and got


# --- extraction -------------------------------------------------------------------------------

def test_pig_line_numbers_and_variables(spark):
    text = "SET a 'x';\nSET a 'y';\nb = FILTER a BY v > 1\n AND w;\nc = FILTER b BY v > 1;\nd = FILTER b BY v > 1;\n"
    df = one(spark, script_id=1, content=text)
    steps = [(r["step_id"], r["line_no"], r["condition"]) for r in pig.pig_transformations(df).orderBy("step_id").collect()]
    assert steps == [("filter_1", 5, "v > 1"), ("filter_2", 6, "v > 1")]
    assert [tuple(r)[1:] for r in pig.pig_variables(df).collect()] == [("a", "y", False)]


def test_sql_references_drop_reserved_words(spark):
    sql = "INSERT INTO db.t SELECT * FROM (SELECT x FROM a.b JOIN c ON 1=1) WHERE xFROM y; CREATE TABLE IF NOT EXISTS n (id INT)"
    got = {(r["kind"], r["value"]) for r in sq.sql_table_refs(one(spark, content=sql)).collect()}
    assert got == {("read", "a.b"), ("read", "c"), ("write", "db.t"), ("write", "n")}


def test_jil_keeps_boundaries_of_condition_words(spark):
    text = "insert_job: a\njob_type: CMD\ncommand: x\ncommand: y\ncondition: terminated(b) & success(c)\n"
    jobs = jb.jil_jobs(one(spark, content=text))
    row = jobs.collect()[0]
    assert row["job_name"] == "a" and row["command"] == "y"
    got = {(r["source_job"], r["condition_type"]) for r in jb.job_dependencies(jobs).collect()}
    assert got == {("b", "terminated"), ("c", "success")}


def test_variables_resolve_in_one_pass(spark):
    df = spark.createDataFrame([("${a}/${b}/${wf:user()}/${zz}/end", {"a": "x", "b": "${a}"})], "t string, p map<string,string>")
    assert oz.resolve_variables(df, "t", "p").collect()[0]["t"] == "x/${a}/<wf:user()>/${zz}/end"


def test_properties_become_a_map(spark):
    df = one(spark, path="/p", content="# c\na = 1\n\nb=x=y\na=2\nplain")
    props = oz.property_map(oz.read_properties(df), "path").collect()[0]["properties"]
    assert props == {"a": "2", "b": "x=y"}


def test_broken_xml_gives_no_actions(spark):
    assert oz.oozie_actions(one(spark, content="<workflow-app><action name='a'><pig>")).count() in (0, 1)
    assert oz.oozie_actions(one(spark, content="no xml")).count() == 0
    assert first(one(spark, c='<?xml version="1.0"?>\n<!-- x -->\n<wf:workflow-app name="n">'), oz.root_tag("c")) == "workflow-app"


def test_notebook_cells(spark):
    doc = '{"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["%sql SELECT 1"]}, {"cell_type": "code", "source": ["a.", "join(b)"]}]}'
    df = one(spark, content=doc)
    assert nb.explode_cells(df).count() == 3
    assert [(r["cell_no"], r["kind"]) for r in nb.cell_transformations(df).collect()] == [(1, "sql"), (2, "join")]


def test_summary_rows(spark):
    rows = [(1, 1, "Graph Name", "g1"), (1, 2, "Input", ""), (1, 3, "x", "110_IFIL temp - /a/b.txt - all rows"), (1, 4, "Output", ""),
            (1, 5, "x", "o1 res - /c/d.txt"), (1, 6, "Graph Name", "g2"), (1, 7, "x", "no dash"), (1, 8, "x", "o2 res - /e")]
    df = spark.createDataFrame(rows, "sheet int, row_no int, key string, value string")
    got = [tuple(r)[2:] for r in gr.parse_summary_rows(df, span=2).orderBy("row_no").collect()]
    assert got == [("g1", "inputs", "110_IFIL", "temp", "/a/b.txt", "all rows"), ("g1", "outputs", "o1", "res", "/c/d.txt", ""),
                   ("g2", "outputs", "o2", "res", "/e", "")]


def test_question_overrides(spark):
    asks = {"please export it": "document_generation", "what replaced x": "workflow_mapping", "compare hadoop and spark": "comparison",
            "trace x": "lineage", "explain it": "logic_analysis", "find x": "code_search", "is it upstream": "lineage", "hello": "simple_rag"}
    df = spark.createDataFrame([(q,) for q in asks], "question string")
    assert {r["question"]: r["intent"] for r in dc.classify_questions(df).collect()} == asks


# --- mappings, search, files ---------------------------------------------------------------------

def test_component_mappings(spark):
    f = "array<struct<name:string,type:string>>"
    rows = [("c1", [("Id", "int"), ("id", "str")], [("ID", "bigint"), ("x", "int")], "", "a", "b"),
            ("c2", [], [("k", "BIGINT")], "", "a", "b"), ("c3", [], [], "", "a", ""), ("c4", [], [], "", "", "")]
    df = spark.createDataFrame(rows, f"component_id string, in_fields {f}, out_fields {f}, logic string, input_dataset string, output_dataset string")
    got = {(r["component_id"], r["source_column"], r["target_column"], r["target_type"], r["mapping_type"], r["rule"])
           for r in st.component_mappings(df).collect()}
    assert got == {("c1", "Id", "ID", "bigint", "direct", "Direct mapping"), ("c1", "", "x", "int", "derived", "Derived column"),
                   ("c2", "", "k", "integer", "output_definition", ""), ("c3", "*", "*", "", "component_level", "Component transformation")}


def test_grid_search_equals_broadcast_search(spark):
    docs = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("vector"))
    queries = spark.range(7).select(F.col("id").alias("query_id"), F.array(*[F.cos(F.col("id") + i) for i in range(4)]).alias("vector"))
    a = {tuple(r) for r in se.vector_search(docs, queries, 3).collect()}
    b = {tuple(r) for r in se.vector_search(docs, queries, 3, max_queries=2).collect()}
    assert a == b and len(a) == 21
    assert se.vector_search(docs, queries.limit(0), 3).count() == 0


def test_ann_finds_most_true_neighbours(spark):
    docs = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(6)]).alias("vector"))
    queries = docs.select(F.col("id").alias("query_id"), "vector").filter("query_id < 10")
    true = {(r["query_id"], r["id"]) for r in se.vector_search(docs, queries, 3).collect()}
    found = {(r["query_id"], r["id"]) for r in se.ann_search(docs, queries, 3, 5.0, bucket=2.0, tables=8).collect()}
    assert len(true & found) / len(true) > .7


def test_merge_hits_blend(spark):
    h = lambda rows: spark.createDataFrame(rows, "path string, score double")
    got = {r["path"]: (round(r["score"], 6), r["matched_chunks"]) for r in se.merge_hits(
        h([("a", .5), ("a", .7)]), h([("a", .9), ("b", .6)]), h([("a", .9), ("c", .4), ("b", .6)])).collect()}
    assert got == {"a": (.96, 2), "b": (.72, 0), "c": (.4, 0)}


def test_scan_files(spark, tmp_path):
    for name, text in {"x/a.pig": "LOAD", "x/.git/b.pig": "no", "y/c.hql": "SELECT", "y/d.txt": "no", "target/e.sql": "no"}.items():
        p = tmp_path / "estate" / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)
    got = {(r["name"], r["ext"], r["size"], r["content"]) for r in src.scan_files(spark, str(tmp_path / "estate"), "hadoop").collect()}
    assert got == {("a.pig", ".pig", 4, "LOAD"), ("c.hql", ".hql", 6, "SELECT")}


def test_json_source_and_csv_preview(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"gap": [{"id": "g1", "n": 1}, {"n": 2}], "other": 3}')
    got = [(r["id"], r["doc_type"]) for r in src.read_json_items(spark, str(tmp_path / "items.json")).orderBy("item_no").collect()]
    assert got == [("g1", "gap"), ("json_gap_1", "gap")]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4\n")
    row = src.profile_csv(spark, str(tmp_path / "t.csv"), 10).collect()[0]
    assert (row["rows"], row["columns"], row["column_names"]) == (2, 2, ["a", "b"]) and len(row["preview"]) == 2


def test_markdown_report(spark, tmp_path):
    df = spark.createDataFrame([("m1", "id", ["a", "b"])], "name string, target string, sources array<string>")
    sinks.write_report(df, str(tmp_path / "md"), "markdown", title="Mapping")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert lines[0] == "### Mapping: m1" and "- **target**: id" in lines
    with pytest.raises(ValueError):
        sinks.write_report(df, str(tmp_path / "x"), "docx")


def test_index_resumes_and_is_idempotent(spark, tmp_path):
    land, out, cp = (str(tmp_path / d) for d in ("land", "out", "cp"))
    rows = lambda *r: spark.createDataFrame(r, "id string, title string, content string, version int")
    first_rows = rows(("1", "a", "x", 1), ("2", "b", None, 1))
    first_rows.coalesce(1).write.mode("append").parquet(land)
    run = lambda: inc.incremental_index(inc.parquet_stream(spark, land, first_rows.schema), out, cp)
    run()
    run()
    assert {(r["id"], r["content"]) for r in inc.indexed_docs(spark, out).collect()} == {("1", "x")}
    rows(("1", "a", "y", 2), ("3", "c", "z", 1)).coalesce(1).write.mode("append").parquet(land)
    run()
    assert {(r["id"], r["content"]) for r in inc.indexed_docs(spark, out).collect()} == {("1", "y"), ("3", "z")}
    assert {r["id"] for r in inc.failed_docs(spark, out).collect()} == {"2"}
    writer = inc.index_batch(out)
    writer(first_rows, 0)
    assert inc.indexed_docs(spark, out).count() == 2


def test_script_stream(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "sub")
    (tmp_path / "in" / "sub" / "a.sql").write_text("SELECT 1")
    (tmp_path / "in" / "b.txt").write_text("no")
    out = str(tmp_path / "o")
    inc.incremental_index(inc.script_stream(spark, str(tmp_path / "in"), "*.sql"), out, str(tmp_path / "c"))
    assert [(r["title"], r["content"]) for r in inc.indexed_docs(spark, out).collect()] == [("a.sql", "SELECT 1")]


def test_changed_and_old_files_are_indexed(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "o")
    os.makedirs(folder)
    (folder / "a.sql").write_text("one")
    (folder / "b.sql").write_text("two")
    seen = lambda: {(r["title"], r["content"]) for r in inc.indexed_docs(spark, out).collect()}
    inc.index_folder(spark, str(folder), "*.sql", out)
    assert seen() == {("a.sql", "one"), ("b.sql", "two")}
    (folder / "a.sql").write_text("one, rewritten")
    (folder / "c.sql").write_text("old")
    os.utime(folder / "c.sql", (10**9, 10**9))
    inc.index_folder(spark, str(folder), "*.sql", out)
    assert seen() == {("a.sql", "one, rewritten"), ("b.sql", "two"), ("c.sql", "old")}
    rows = spark.read.parquet(out).count()
    inc.index_folder(spark, str(folder), "*.sql", out)
    assert spark.read.parquet(out).count() == rows == 4


def test_no_row_of_a_batch_is_lost(spark, tmp_path):
    out = str(tmp_path / "o")
    rows = spark.createDataFrame([("1", "a", "x", 1), ("", "b", "y", 1), (None, "c", "z", 1), ("4", None, "", 1)], "id string, title string, content string, version int")
    inc.index_batch(out)(rows, 0)
    assert inc.indexed_docs(spark, out).count() + inc.failed_docs(spark, out).count() == rows.count()


def test_process_document_lists_parameters(spark):
    df = spark.createDataFrame([("p", "n", "s", {"a": "1"}, 3)], "id string, name string, system string, parameters map<string,string>, component_count int")
    text = dc.to_documents(df, "process", "id").collect()[0]["content"]
    assert text.startswith("Process: n\nSystem: s\nType: N/A") and "\nParameters:\n  - a: 1" in text and text.endswith("Components: 3 components")


def test_metadata_and_questions_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([("m", "a", None, "t1", "int")], "mapping_id string, source_column string, target_column string, source_table string, source_type string")
    row = dc.to_documents(df, "sttm", "mapping_id", metadata=True).collect()[0]
    assert row["content"].endswith("Transformation: N/A\nData Type: int → N/A")
    assert row["metadata"] == {"doc_type": "sttm", "name": "a → ", "source_table": "t1", "target_table": "", "source_system": "", "target_system": ""}
    asked = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), ("", "")], "s string, t string").select(
        dc.gap_question("s", "t"), dc.gap_question("s"), dc.sttm_question("s", "t"), dc.process_question("s")).collect()
    assert [r[0] for r in asked] == ["What gaps exist between a and b?", "What gaps exist in a?", "What gaps exist?", "What gaps exist?"]
    assert [r[1] for r in asked][:2] == ["What gaps exist in a?"] * 2
    assert [r[2] for r in asked][::2] == ["Show me source-to-target mappings from source table a to target table b", "Show me source-to-target mappings to target table b"]
    assert asked[0][3] == "What does the process 'a' do?"


def test_actions_without_known_properties_keep_their_names(spark):
    flow = "<workflow-app><action name='a'><spark><master>yarn</master><arg>input=${in}</arg><arg>output_${out}</arg></spark></action></workflow-app>"
    actions = oz.oozie_actions(spark.createDataFrame([(1, flow), (2, flow)], "k int, content string"))
    known = spark.createDataFrame([(1, {"in": "x"})], "k int, properties map<string,string>")
    got = {r["k"]: (r["parameters"], r["inputs"], r["outputs"]) for r in oz.resolve_actions(actions, known, "k").collect()}
    assert got == {1: (["master=yarn"], ["input=x"], ["output_${out}"]), 2: (["master=yarn"], ["input=${in}"], ["output_${out}"])}


def test_signatures_of_texts_and_of_analyses_share_a_schema(spark):
    from estatelens.operators import workflow_mapping as wm
    from estatelens.sources.files import signatures_from_json
    pig_text = "a = LOAD '/In/x' USING P(); b = load '/In/x'; STORE b INTO '/out/y';"
    py_text = 'spark.read.csv("/in/z").write.mode("append").save("/out/z")'
    scripts = spark.createDataFrame([("hadoop", "p", "p.pig", pig_text), ("databricks", "n", "n.py", py_text), ("other", "o", "o", py_text), ("hadoop", "e", "e", "")],
                                    "system string, name string, path string, content string")
    rows = wm.signatures(scripts, files=True)
    got = {r["name"]: (r["source_files"], r["target_files"]) for r in rows.collect()}
    assert got == {"p": (["/In/x"], ["/out/y"]), "n": (["/in/z"], ["/out/z"]), "o": ([], []), "e": ([], [])}
    stored = signatures_from_json(one(spark, content='{"graphs": {"g": {"inputs": [{"file_path": "f"}], "transformations": ["Join"], "summary": ""}}}'))
    both = rows.unionByName(stored)
    assert set(both.columns) == set(rows.columns) == set(stored.columns) and both.count() == 5


def test_prefixes_are_cut_only_when_asked(spark):
    code = "SELECT * FROM a JOIN b ON " + " AND ".join(f"a.c{k} = b.c{k}" for k in range(60)) + ";"
    whole, cut = (sq.sql_transformations(one(spark, content=code), n).filter("kind = 'join'").collect()[0]["snippet"] for n in (None, 200))
    assert len(cut) == 200 and len(whole) > 200 and whole.startswith(cut)


def test_top_k_is_cut_before_the_shuffle(spark):
    hits = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = se.topk_per_group(hits, 2, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_answer_context_searches_the_named_system(spark):
    from estatelens.plans import analysis
    docs = spark.createDataFrame([(1, [0.0, 0.0], "hadoop", "process", "one"), (2, [0.1, 0.0], "databricks", "process", "two"),
                                  (3, [5.0, 5.0], "hadoop", "gap", "three")],
                                 "id long, vector array<double>, system string, doc_type string, content string")
    asks = spark.createDataFrame([(7, "explain the hadop job", [0.0, 0.0]), (8, "hello", [0.0, 0.0])],
                                 "query_id long, question string, vector array<double>")
    result = analysis.answer_context(asks, docs, 2)
    assert {(r["query_id"], r["id"]) for r in result["hits"].collect()} == {(7, 1), (7, 3), (8, 1), (8, 2)}
    assert {r["query_id"]: r["confidence"] for r in result["context"].collect()} == {7: "medium", 8: "medium"}


def test_report_takes_columns_of_the_input(spark):
    from estatelens.operators import sttm
    row = ("p", "s", "a", "b", "int", "c", "d", "int", 1, "", "1:1", True, False, 0.5, "by hand")
    names = ["process_name", "system", "source_table", "source_column", "source_type", "target_table", "target_column", "target_type",
             "processing_order", "rule", "mapping_type", "source_is_pk", "target_is_nullable", "mapping_confidence", "notes"]
    got = sttm.sttm_report(spark.createDataFrame([row], names), ["source_column"]).first()
    assert (got["Source_Is_PK"], got["Target_Is_PK"], got["Target_Is_Nullable"], got["Mapping_Confidence"]) == ("Y", "N", "N", 0.5)
    assert got["Notes"] == "by hand"


def test_classes_of_components_are_never_broadcast(spark):
    comps = spark.createDataFrame(
        [(f"c{i}", f"p{i % 2}", [("id", "int"), (f"q{i % 3}", "string")], [("id", "int")], ["d"], ["d"]) for i in range(12)],
        "component_id string, process_id string, in_fields array<struct<name:string,type:string>>, "
        "out_fields array<struct<name:string,type:string>>, inputs array<string>, outputs array<string>")
    pairs = spark.createDataFrame([("p0", "p1")], "source_process string, target_process string")
    listed = st.cross_process_mappings(pairs, comps, comps)
    for rows in (st.cross_process_classes(pairs, comps, comps), listed):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_class#" in line]
    assert listed.count() == 6 * 6 * 2
