"""Scans that leave folders out, capped rows, and an index whose files go back to an older state."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import gaps as gp
from estatelens.operators import rollups as ru
from estatelens.sources import files as src
from estatelens.sources import sinks
from estatelens.streaming import incremental as inc


def test_skipped_folders_are_not_opened(spark, tmp_path):
    for folder in ("jobs", "target/x", "jobs/build"):
        (tmp_path / folder).mkdir(parents=True)
        for k in range(3):
            (tmp_path / folder / f"{k}.hql").write_text(f"SELECT {k}")
    found = src.scan_files(spark, str(tmp_path), "hadoop")
    assert sorted(r["content"] for r in found.collect()) == ["SELECT 0", "SELECT 1", "SELECT 2"]
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 3


@pytest.mark.parametrize("n", [0, 1, 7, 50, 1000])
def test_capped_rows_are_the_first_ones(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, 1, 2, 3]), r.choice(["a", "b", None]), k) for k in range(60)]
    got = sinks.cap_rows(spark.createDataFrame(rows, "x int, y string, z long"), ["x", "y"], n).collect()
    low = lambda v: (v is not None, v)
    want = sorted(((low(x), low(y)) for x, y, _ in rows))[:n]
    assert sorted((low(g["x"]), low(g["y"])) for g in got) == want and len({g["z"] for g in got}) == len(want)


def test_a_restored_file_is_indexed_again(spark, tmp_path):
    out = str(tmp_path / "index")
    scan = lambda content, version: spark.createDataFrame(
        [("f", "t", content, version, f"f_{len(content)}_{version}"), ("g", "t", "same", 1, "g_4_1")], "id string, title string, content string, version int, file_key string")
    seen = lambda: {(r["id"], r["content"], r["version"]) for r in inc.indexed_docs(spark, out).collect()}
    for content, version in (("old", 1), ("newer", 2), ("old", 1), ("old", 1), ("newest", 3), ("newer", 2)):
        inc.index_changes(scan(content, version), out)
        assert seen() == {("f", content, version), ("g", "same", 1)}
    rows = inc.stored(spark, out)
    assert rows.where("id = 'g'").count() == 1 and rows.where("id = 'f'").count() == 5


def test_columns_are_compared_per_equivalent_component(spark):
    pairs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "x")], "source_component string, target_component string")
    fields = spark.createDataFrame([("a", "Id"), ("a", "Amt"), ("b", "k"), ("c", "k"), ("x", "ID"), ("x", "flag"), ("y", "K"), ("d", "id")], "component_id string, field string")
    got = {(r["source_component"], r["target_component"], r["item"]) for r in gp.missing_component_columns(pairs, fields).collect()}
    assert got == {("a", "x", "amt")}


def test_rollup_counts_distinct_values_in_every_group(spark):
    r = random.Random(2)
    rows = [(r.choice(["h", "d", None]), r.choice(["f", "j", None]), r.choice(["p1", "p2", None]), r.choice(["a", "b", "c"]), r.choice([None, "z"])) for _ in range(80)]
    df = spark.createDataFrame(rows, "system string, component_type string, process_id string, input_dataset string, output_dataset string")
    got = sorted(map(str, ru.repository_rollup(df).collect()))
    want = df.rollup("system", "component_type").agg(
        F.count("*").alias("components"), F.countDistinct("process_id").alias("processes"),
        F.countDistinct("input_dataset").alias("sources"), F.countDistinct("output_dataset").alias("targets"))
    assert got == sorted(map(str, want.collect()))
