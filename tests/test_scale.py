"""What a task holds and what a query moves must not grow with the input."""

import contextlib
import io

from pyspark.sql import functions as F

from estatelens.functions import scale
from estatelens.functions.scale import cut_lineage, dealt
from estatelens.operators import gaps as gp
from estatelens.operators import lineage as ln
from estatelens.operators import matching as mt
from estatelens.operators import search as se
from estatelens.operators import sttm as st
from estatelens.plans import estate_queries as eq
from estatelens.plans import search_queries as sq


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_texts_are_moved_once_and_terms_never(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (2, "c d"), (None, "a x"), (4, None), (5, "")], "id int, text string")
    small = se.vectorize(docs)
    assert plan(small).count("hashpartitioning(") == 1 and "hashpartitioning(id" in plan(small)
    rows = lambda df: {(r["id"], r["term"]): round(r["weight"], 9) for r in df.collect()}
    want = rows(small)
    monkeypatch.setattr(se, "TERMS", 0)  # more terms than may be broadcast
    assert rows(se.vectorize(docs)) == want
    assert set(want) == {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (2, "d")}


def test_tasks_grow_in_number_with_rows(spark):
    few, many = dealt(spark.range(100), 1_000, "id"), dealt(spark.range(100_000), 1_000, "id")
    assert few.rdd.getNumPartitions() == 8 and many.rdd.getNumPartitions() == 100


def test_equivalents_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    pairs = spark.createDataFrame([("s", "t")], "source_process string, target_process string")
    side = lambda p, names: spark.createDataFrame([(f"{p}{i}", p, n, [f"d{i}"]) for i, n in enumerate(names)],
                                                  "component_id string, process_id string, name string, datasets array<string>")
    source, target = side("s", ["Load", "xy", "stage_a", "none", None]), side("t", ["load", "wxyz", "a", "other", "z"])
    for name in ("ROWS_PER_TASK", "NAMES_PER_TASK"):
        monkeypatch.setattr(mt, name, 1)
    dealt_to, real = [], mt.dealt
    monkeypatch.setattr(mt, "dealt", lambda df, rows, *keys: dealt_to.append(keys) or real(df, rows, *keys))
    got = {tuple(r) for r in mt.equivalent_component(pairs, source, target).collect()}
    assert got == {("s0", "t0", 1), ("s1", "t1", 2), ("s2", "t2", 2), ("s3", "t3", 3), ("s4", "t4", 3)}
    assert sorted(dealt_to) == [("component_id",), ("pid", "ds"), ("pid", "nm"), ("pid", "nm")]


def test_fields_are_made_distinct_in_dealt_tasks(spark, monkeypatch):
    equivalents = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "source_component string, target_component string")
    fields = spark.createDataFrame([("a", "X"), ("a", "x"), ("a", "y"), ("b", "Y"), ("c", "z")], "component_id string, field string")
    dealt_to, real = [], gp.dealt
    monkeypatch.setattr(gp, "FIELDS_PER_TASK", 1)
    monkeypatch.setattr(gp, "dealt", lambda df, rows, *keys: dealt_to.append(keys) or real(df, rows, *keys))
    rows = gp.missing_component_columns(equivalents, fields).select("source_component", "target_component", "item").collect()
    assert sorted(map(tuple, rows)) == [("a", "b", "x")] * 2 and dealt_to == [("id", "item")]


def test_scripts_are_written_without_a_folder_each(spark, tmp_path):
    rows = spark.createDataFrame([("jobs", 5, "a é"), ("jobs", 5, "b"), ("jobs", 1005, None), ("target", 8, "x")], "place string, script_id int, value string")
    sq.write_scripts(rows.repartition(2, "script_id").sortWithinPartitions("script_id"), str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text(encoding="utf-8") for p in tmp_path.rglob("*.txt")}
    lines = found.pop("place=jobs/part=5/script_id=5.txt")
    assert sorted(lines.split("\n")) == ["", "a é", "b"]
    assert found == {"place=jobs/part=5/script_id=1005.txt": "\n", "place=target/part=8/script_id=8.txt": "x\n"}


def test_a_hop_moves_its_frontier_only(spark):
    edges = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 50).alias("script"), F.concat(F.lit("t"), F.col("id") % 90).alias("tab"))
    reads, writes = ln._script_edges(edges.union(edges), edges)
    assert reads.count() == edges.distinct().count()
    frontier = cut_lineage(edges.select("tab").distinct()).hint("merge")
    hop = plan(reads.join(frontier, "tab"))
    assert hop.count("hashpartitioning(tab") == 1
    level = cut_lineage(edges.select("script").distinct()).hint("merge")
    assert plan(writes.join(level, "script", "left_semi")).count("hashpartitioning(script") == 1


def test_a_report_moves_components_and_stages_what_it_shows(spark, tmp_path, monkeypatch):
    rows = [(o, n, None if o is None else 7 * o % 5, None if o is None else o % 3) for o in (5, 1, None, 12, 1) for n in (1, 2, 3, 4, 4)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    staged, real = [], scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", lambda df: staged.append(df) or real(df))
    report = eq.sttm_report(spark, str(tmp_path)).collect()
    wide = max(staged, key=lambda df: len(df.columns))
    assert not {"mapping_id", "component_id", "name", "process_id"} & set(wide.columns)
    steps = plan(wide)
    assert steps.count("Exchange rangepartitioning") == 1 and steps.index("Sort [") < steps.index("Generate ") < steps.index("Exchange rangepartitioning")
    order = ["component_id", "processing_order", "target_column"]
    mappings = st.component_mappings(eq.components(spark, str(tmp_path))).sort(*order).collect()
    shown = ("source_column", "target_column", "target_type", "processing_order", "mapping_type")
    titles = ("Source_Column", "Target_Column", "Target_Datatype", "Processing_Order", "Mapping_Type")
    assert len(report) == len(mappings) == 48
    report.sort(key=lambda r: r["STTM_ID"])
    assert [r["STTM_ID"] for r in report] == [f"sttm_{k:05}" for k in range(1, len(report) + 1)]
    assert [r["Target_Column"] for r in report] == [m["target_column"] for m in mappings]
    assert sorted(str([r[c] for c in titles]) for r in report) == sorted(str([m[c] for c in shown]) for m in mappings)


def test_numbers_come_beside_the_columns_asked_for(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("b", 1, "y"), ("a", 2, "z")], "g string, n int, t string")
    got = scale.number_rows(rows, ["n"], ["g"], columns=["t"])
    assert got.columns == ["t", "row_number"] and {tuple(r) for r in got.collect()} == {("z", 1), ("x", 2), ("y", 1)}


def test_a_level_of_nested_workflows_does_not_meet_all_facts(spark, monkeypatch):
    real = ln.cut_lineage
    def scans(length):
        seen = []
        monkeypatch.setattr(ln, "cut_lineage", lambda df: seen.append(plan(df).count("FileScan")) or real(df))
        links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(length)], "parent string, child string")
        io = spark.createDataFrame([(f"w{k}", "input", f"d{k}") for k in range(length + 1)], "workflow string, direction string, dataset string")
        assert ln.nested_io(links, io).count() == (length + 1) * (length + 2) // 2
        return max(seen)
    assert scans(14) - scans(6) <= 3


def test_components_with_a_name_hit_do_not_move_by_dataset(spark, monkeypatch):
    pairs = spark.createDataFrame([("s", "t"), ("s", "u")], "source_process string, target_process string")
    side = lambda rows: spark.createDataFrame(rows, "component_id string, process_id string, name string, datasets array<string>")
    target = side([("t0", "t", "load", ["d0"]), ("u1", "u", "other", ["d1"]), ("u2", "u", "z", ["d0"])])
    dealt_to, real = [], mt.dealt
    monkeypatch.setattr(mt, "dealt", lambda df, rows, *keys: dealt_to.append(keys) or real(df, rows, *keys))
    rows = lambda source: sorted(tuple(r) for r in mt.equivalent_component(pairs, side(source), target).collect())
    assert rows([("s0", "s", "Load", ["d0"]), ("s1", "s", "x_load_other", ["d1"])]) == [("s0", "t0", 1), ("s0", "t0", 3), ("s1", "t0", 2), ("s1", "u1", 2)]
    assert ("pid", "ds") in dealt_to  # s0 has no name in u; the least target over all of its rows counts, t0 by d0
    dealt_to.clear()
    assert rows([("s1", "s", "x_load_other", ["d1"]), ("s1", "s", "x_load_other", None)]) == [("s1", "t0", 2)] * 2 + [("s1", "u1", 2)] * 2
    assert ("pid", "ds") not in dealt_to


def test_fields_of_a_component_travel_as_one_row(spark):
    fields = spark.createDataFrame([("a", "X"), ("a", "x"), ("a", None), ("a", "y"), ("b", "Y"), ("b", None), (None, "q"), (None, "r"), ("c", "z"), ("a", "w")], "id string, item string").coalesce(1)
    packed = gp._packed(fields.withColumn("item", F.lower("item")))
    assert sorted((r["id"] or "", r["item"]) for r in packed.collect()) == [("", ["q"]), ("", ["r"]), ("a", ["w"]), ("a", ["x", "y", None]), ("b", ["y", None]), ("c", ["z"])]
    equivalents = spark.createDataFrame([("a", "b"), ("c", "a"), ("b", "none"), (None, "b")], "source_component string, target_component string")
    rows = gp.missing_component_columns(equivalents, fields.toDF("component_id", "field")).select("source_component", "target_component", "item").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", "b", "x"), ("a", "b", "w"), ("a", "b", None), ("c", "a", "z")]))


def test_shuffle_files_go_after_a_long_step(spark, monkeypatch):
    from estatelens.functions import scale
    asked = []
    monkeypatch.setattr(scale, "_let_go", lambda session, seconds: asked.append(seconds >= 0))
    assert scale.cut_lineage(spark.range(3)).count() == 3 and asked == [True]


def test_component_pairs_are_listed_where_they_meet(spark):
    field = lambda *names: [(n, "int") for n in names]
    comps = spark.createDataFrame(
        [("a", "p0", [], field("id", "x"), ["i"], ["d1", "d2", "d1"]), ("a2", "p0", [], field("id"), ["i"], ["d2"]), ("a2", "p0", [], field("id"), ["i"], ["d2"]),
         ("b", "p1", field("ID"), [], ["d2", "d1"], None), ("b2", "p1", field("x"), [], ["d1"], None), ("c", "p1", field("x"), [], [None], None)],
        "component_id string, process_id string, in_fields array<struct<name:string,type:string>>, "
        "out_fields array<struct<name:string,type:string>>, inputs array<string>, outputs array<string>")
    pairs = spark.createDataFrame([("p0", "p1"), ("p0", "p1"), ("p1", None)], "source_process string, target_process string")
    rows = st.cross_process_mappings(pairs, comps, comps)
    got = sorted((r["source_component"], r["target_component"], r["source_column"], r["target_column"]) for r in rows.collect())
    assert got == [("a", "b", "id", "ID"), ("a", "b2", "x", "x"), ("a2", "b", "id", "ID"), ("a2", "b", "id", "ID")]
    plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet, so there is one
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 2  # components of either side; no pair
