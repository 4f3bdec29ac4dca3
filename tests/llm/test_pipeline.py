"""The pipeline against its stages in plain Python, and the registered queries against their SQL."""

import re

import duckdb
import pytest

import __spark_entry__
import check
import corpus_pipeline
from estatelens.llm import quality_rules, queries, secret_scan
from estatelens.llm.common import read

from . import plain
from .test_text_operators import FOLDER, given

TABLES = "documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    ok, note = check.compare(spark, con, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == set(map(str, range(1, 14))) and {"pipeline", *queries.QUERIES} <= names.keys()


def test_stages_equal_the_plain_version(spark):
    texts = given(spark)
    labels = read(spark, FOLDER, "labels")
    kept = {r["doc_id"] for r in quality_rules.judge(read(spark, FOLDER, "documents"), labels).where("kept").collect()}
    texts = {i: t for i, t in texts.items() if i in kept}
    after = plain.dedup_lines(texts)
    texts = {i: t for i, t in after.items() if t.strip() or not texts[i].strip()}
    parts = plain.jaccard(texts, 5, 4, 5)
    texts = {i: t for i, t in texts.items() if parts[i][1] == i}
    texts = {i: plain.masked(t, plain.secrets(t, secret_scan.RULES, secret_scan.LEAST), corpus_pipeline.MASK) for i, t in texts.items()}

    docs = read(spark, FOLDER, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
    rows = docs.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] != given(spark)[r["doc_id"]])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(texts)


def test_stages_take_empty_tables_and_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "w " * 40, "en", "s", 80),
                                 (3, " ".join(f"w{k}" for k in range(40)) + " password=abcdef1", "en", "s", 9)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            docs.count()
    plain_rows = corpus_pipeline.secrets(spark, odd, FOLDER).collect()
    assert sorted(str(r["text"])[-9:] for r in plain_rows) == sorted(["None", "", "", ("w " * 40)[-9:], "[secret]"[-9:] if len("[secret]") > 8 else " [secret]"])
