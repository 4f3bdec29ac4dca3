"""Registered queries for questions, documents, retrieval, sources, sinks and indexing."""

from __future__ import annotations

import os
import uuid
from itertools import groupby
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import shared_folder
from estatelens.operators import documents as dc
from estatelens.operators import pig_scripts as pig
from estatelens.operators import search as se
from estatelens.plans.registry import lit, lit_list, query
from estatelens.plans.views import table, texts, view
from estatelens.sources import files as src
from estatelens.sources import sinks
from estatelens.streaming import incremental as inc


def scratch(spark, name: str) -> str:
    """A new folder below the shared folder, one per run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- questions and structure ---------------------------------------------------------------

_any = lambda ws, x="low": "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in ws) + ")"
_rx = lambda p: f"CAST(regexp_matches(question, {lit(p)}) AS INT)"
_SCORES = ", ".join(f"{' + '.join(_rx(p) for p in ps)} AS s{i}" for i, ps in enumerate(vocab.INTENT_PATTERNS.values()))
_INTENTS = list(vocab.INTENT_PATTERNS)
_OV = vocab.INTENT_OVERRIDES


def _when(i, what):
    intent, conf, phrases = _OV[i]
    return f"WHEN {_any(phrases)} THEN {lit(intent) if what == 'intent' else f'{conf}::DOUBLE'}"


def _decide(what):
    compare = f"WHEN len(sys) >= 2 AND {_any(vocab.COMPARISON_WORDS)} THEN " + ("'comparison'" if what == "intent" else "0.95::DOUBLE")
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(_INTENTS))) + ")"
    by_score = " ".join(f"WHEN s{i} = {top} THEN {lit(n) if what == 'intent' else '0.7::DOUBLE'}" for i, n in enumerate(_INTENTS))
    return (f"CASE {_when(0, what)} {_when(1, what)} {compare} {' '.join(_when(i, what) for i in range(2, len(_OV)))} "
            f"WHEN {top} = 0 THEN {lit('simple_rag') if what == 'intent' else '0.6::DOUBLE'} {by_score} END")


# RE2 ends words at accented letters, so words with such letters are blanked for the name pattern
_ASCII_WORDS = r"regexp_replace(question, '[0-9A-Za-z_]*[^\x00-\x7F]([0-9A-Za-z_]|[^\x00-\x7F])*', ' ', 'g')"
_ENT = "list_sort(list_distinct(list_concat(" + ", ".join(
    f"regexp_extract_all({_ASCII_WORDS if i == 1 else 'question'}, {lit(p)}, 1)" for i, p in enumerate(vocab.QUESTION_ENTITY_PATTERNS)) + ")))"
_KW = f"list_concat(list_filter({lit_list(vocab.COMPARISON_WORDS)}, lambda w: contains(low, w)), list_filter({lit_list(vocab.LINEAGE_WORDS)}, lambda w: contains(low, w)))"
_SYS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(question, {lit(p)}) THEN {lit(s)} END" for s, p in vocab.QUESTION_SYSTEMS.items()) + "], lambda x: x IS NOT NULL)"


@query("classify_questions", views=("questions",), oracle=f"""
WITH q AS (SELECT *, lower(question) AS low, {_SYS} AS sys, {_SCORES} FROM questions)
SELECT conv_id, turn, array_to_string(sys, '|') AS systems, array_to_string({_ENT}, '|') AS entities, array_to_string({_KW}, '|') AS keywords,
  {_decide('intent')} AS intent, {_decide('confidence')} AS confidence FROM q
""")
def classify_questions(spark, folder):
    return dc.classify_questions(view(spark, folder, "questions")).drop("question")


_title = lambda s: " ".join(w.capitalize() for w in s.split(" "))


def _fixed():
    e = "question"
    for wrong, right in vocab.TERM_CORRECTIONS.items():
        e = f"CASE WHEN contains(lower(question), {lit(wrong)}) THEN replace(replace({e}, {lit(wrong)}, {lit(right)}), {lit(_title(wrong))}, {lit(_title(right))}) ELSE {e} END"
    return e


@query("normalize_terms", views=("questions",), oracle=f"SELECT conv_id, turn, md5({_fixed()}) AS text_hash, left({_fixed()}, 60) AS head FROM questions")
def normalize_terms(spark, folder):
    q = dc.normalize_terms(view(spark, folder, "questions"))
    return q.select("conv_id", "turn", F.md5("question").alias("text_hash"), F.left("question", F.lit(60)).alias("head"))


_SHEETS = """sheets AS (SELECT p_partkey, concat(CASE p_partkey % 7 WHEN 0 THEN 'Compare ' WHEN 1 THEN 'Field Mapping ' WHEN 2 THEN 'STTM ' WHEN 3 THEN 'A vs B ' ELSE '' END, p_brand) AS sheet,
  concat(p_type, ',', CASE p_size % 4 WHEN 0 THEN 'Source Col' WHEN 1 THEN 'Hadoop' ELSE 'x' END) AS cols FROM part)"""


@query("detect_structure", oracle=f"""
WITH {_SHEETS}, f AS (SELECT p_partkey, {_any(vocab.COMPARISON_SHEET_WORDS, 'lower(sheet)')} AS bn, {_any(vocab.COMPARISON_COLUMN_WORDS, "replace(lower(cols), ',', ' ')")} AS bc, {_any(vocab.MAPPING_SHEET_WORDS, 'lower(sheet)')} AS im, {_any(vocab.STTM_SHEET_WORDS, 'lower(sheet)')} AS st FROM sheets)
SELECT p_partkey, CASE WHEN st THEN 'sttm_sheet' WHEN bn OR bc THEN 'comparison_sheet' WHEN im THEN 'mapping_table' ELSE 'unknown' END AS detected_type, bn OR bc AS is_comparison, im AS is_mapping, st AS is_sttm,
  CASE WHEN st OR bn THEN 'high' WHEN im AND NOT bc THEN 'medium' ELSE 'low' END AS confidence FROM f
""")
def detect_structure(spark, folder):
    table(spark, folder, "part").createOrReplaceTempView("part")
    sheets = spark.sql(f"WITH {_SHEETS} SELECT * FROM sheets").withColumn("columns", F.split("cols", ","))
    return dc.detect_structure(sheets).drop("sheet", "cols", "columns")


@query("detect_json_structure", views=("analysis_json",), oracle="""
SELECT doc_id, false AS is_workflow_mapping, starts_with(content, '{"pipelines"') AS is_notebook_analysis, false AS is_validation_report FROM analysis_json
""")
def detect_json_structure(spark, folder):
    docs = view(spark, folder, "analysis_json").select("doc_id", F.json_object_keys("content").alias("keys"))
    return dc.detect_json_structure(docs).drop("keys")


# --- sources ----------------------------------------------------------------------------------

@query("json_items", views=("item_json",), oracle="""
SELECT event_id AS source_id, CAST(0 AS BIGINT) AS item_no, regexp_extract(content, '"id": "([^"]*)"', 1) AS id, CASE WHEN starts_with(content, '[') THEN regexp_extract(content, '"type": "([^"]*)"', 1) ELSE regexp_extract(content, '^\\{"(\\w+)"', 1) END AS doc_type FROM item_json
UNION ALL SELECT event_id, 1, concat('json_', CASE WHEN starts_with(content, '[') THEN 'item' ELSE regexp_extract(content, '^\\{"(\\w+)"', 1) END, '_1'), CASE WHEN starts_with(content, '[') THEN 'unknown' ELSE regexp_extract(content, '^\\{"(\\w+)"', 1) END FROM item_json
""")
def json_items(spark, folder):
    return src.json_items(view(spark, folder, "item_json"), "event_id").drop("content")


_set = lambda e: f"array_to_string(list_sort(list_distinct({e})), '|')"
_kw = lambda e: f"array_to_string(list_sort(list_filter({lit_list(vocab.BUSINESS_TERMS)}, lambda w: contains(lower({e}), w))), '|')"


@query("signatures_from_json", views=("analysis_json",), oracle=f"""
WITH n AS (SELECT doc_id, doc_id - doc_id % 4 AS b, content FROM analysis_json)
SELECT 'databricks' AS system, concat('nb_claim_', CAST(doc_id AS VARCHAR)) AS name, concat('/nb/', CAST(doc_id AS VARCHAR)) AS path, concat('a_', CAST(b AS VARCHAR), '|b_', CAST(b AS VARCHAR)) AS source_tables, concat('o_', CAST(doc_id AS VARCHAR)) AS target_tables,
  '' AS source_files, concat('/out/', CAST(doc_id AS VARCHAR)) AS target_files, 'filter|join' AS transformation_types, {_kw("concat('nb_claim_', CAST(doc_id AS VARCHAR), ' /nb/', CAST(doc_id AS VARCHAR))")} AS business_keywords FROM n WHERE doc_id % 2 = 0
UNION ALL SELECT 'databricks', concat('two_', CAST(doc_id AS VARCHAR)), concat('/policy/', CAST(doc_id AS VARCHAR)), '', '', concat('/i/', CAST(doc_id % 3 AS VARCHAR)), '', 'group_by', {_kw("concat('policy', CAST(doc_id AS VARCHAR))")} FROM n WHERE doc_id % 2 = 0
UNION ALL SELECT 'abinitio', concat('gr_lead_', CAST(doc_id AS VARCHAR)), concat('gr_lead_', CAST(doc_id AS VARCHAR)), '', '', concat('/in/', CAST(b AS VARCHAR)), concat('/out/', CAST(doc_id AS VARCHAR)), 'join|sort',
  {_kw("concat('gr_lead_', CAST(doc_id AS VARCHAR), ' ', regexp_extract(content, 'summary\": \"([^\"]*)', 1))")} FROM n WHERE doc_id % 2 = 1
""")
def signatures_from_json(spark, folder):
    return src.signatures_from_json(view(spark, folder, "analysis_json"))


@query("select_files", views=("files",), oracle="""
SELECT file_id, path FROM files WHERE system = 'databricks' AND regexp_matches(path, '\\.(py|sql|sh)$') AND NOT contains(path, 'build')
""")
def select_files(spark, folder):
    files = view(spark, folder, "files").filter("system = 'databricks'").select("file_id", "path")
    return src.select_files(files, vocab.SYSTEM_EXTENSIONS["databricks"])


@query("profile_csv", oracle="""
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, 'o_orderkey|o_custkey|o_orderstatus|o_totalprice|o_orderdate|o_orderpriority' AS column_names FROM orders
""")
def profile_csv(spark, folder):
    path = scratch(spark, "orders-csv")
    table(spark, folder, "orders").write.option("header", "true").csv(path)
    return src.profile_csv(spark, path, 10).drop("preview")


@query("profile_text", oracle="""
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, length(text) AS characters, md5(array_to_string(string_split(text, chr(10))[1:20], chr(10))) AS preview FROM documents
""")
def profile_text(spark, folder):
    p = src.profile_text(texts(spark, folder).select("doc_id", "text"), preview=20)
    return p.withColumn("preview", F.md5("preview"))


# --- documents --------------------------------------------------------------------------------

@query("to_documents_component", views=("components",), oracle="""
SELECT component_id AS id, 'component' AS doc_type, concat('Component: ', component_id, chr(10), 'Type: ', component_type, chr(10), 'System: ', system, chr(10), 'Process: ', process_id, chr(10), 'Description: N/A', chr(10), chr(10), 'Input Datasets: ', input_dataset, chr(10), 'Output Datasets: ', output_dataset) AS content FROM components
""")
def to_documents_component(spark, folder):
    c = view(spark, folder, "components").withColumn("name", F.col("component_id")) \
        .withColumn("input_datasets", F.array("input_dataset")).withColumn("output_datasets", F.array("output_dataset"))
    return dc.to_documents(c, "component", "component_id", max_items=5, max_chars=300, max_params=10)


@query("to_documents_process", views=("processes",), oracle="""
SELECT process_id AS id, 'process' AS doc_type, concat('Process: ', name, chr(10), 'System: ', system, chr(10), 'Type: N/A', chr(10), 'Description: N/A', chr(10), 'Business Function: ', business_function, chr(10), 'File Path: ', path) AS content FROM processes
""")
def to_documents_process(spark, folder):
    return dc.to_documents(view(spark, folder, "processes"), "process", "process_id", max_items=5, max_chars=300, max_params=10)


@query("to_documents_gap", views=("gaps",), oracle="""
SELECT gap_id AS id, 'gap' AS doc_type, concat('Gap: ', gap_type, chr(10), 'Name: N/A', chr(10), 'Description: N/A', chr(10), 'Severity: ', severity, chr(10), 'Source System: ', source_system, chr(10), 'Target System: N/A', chr(10), 'Impact: N/A', chr(10), 'Recommendation: N/A') AS content FROM gaps
""")
def to_documents_gap(spark, folder):
    return dc.to_documents(view(spark, folder, "gaps"), "gap", "gap_id", max_items=5, max_chars=300, max_params=10)


@query("to_documents_sttm", views=("component_schemas",), oracle="""
SELECT component_id AS id, 'sttm' AS doc_type, concat('STTM Mapping: N/A', chr(10), 'Source Column: *', chr(10), 'Source Table: ', input_dataset, chr(10), 'Source System: N/A', chr(10), 'Target Column: *', chr(10), 'Target Table: ', output_dataset, chr(10), 'Target System: N/A', chr(10), 'Transformation: ', CASE logic WHEN '' THEN 'N/A' ELSE logic END, chr(10), 'Data Type: N/A → N/A') AS content FROM component_schemas
""")
def to_documents_sttm(spark, folder):
    c = view(spark, folder, "component_schemas").select(
        "component_id", F.lit("*").alias("source_column"), F.col("input_dataset").alias("source_table"),
        F.lit("*").alias("target_column"), F.col("output_dataset").alias("target_table"), F.col("logic").alias("rule"))
    return dc.to_documents(c, "sttm", "component_id", max_items=5, max_chars=300, max_params=10)


@query("documents_with_metadata", views=("component_schemas",), oracle="""
SELECT component_id AS id, 'sttm' AS doc_type, concat('STTM Mapping: ', component_id, chr(10), 'Source Column: ', name, chr(10), 'Source Table: ', input_dataset, chr(10), 'Source System: ', system, chr(10), 'Target Column: *', chr(10), 'Target Table: ', output_dataset, chr(10), 'Target System: N/A', chr(10),
  'Transformation: ', CASE logic WHEN '' THEN 'N/A' ELSE logic END, chr(10), 'Data Type: ', CASE in_spec WHEN '' THEN 'N/A' ELSE in_spec END, ' → ', CASE out_spec WHEN '' THEN 'N/A' ELSE out_spec END) AS content,
  concat(name, ' → *') AS name, input_dataset AS source_table, '' AS target_system,
  concat('Show me source-to-target mappings from source table ', input_dataset, ' for column ', name, ' → *') AS question
FROM component_schemas WHERE system = 'hadoop'
""")
def documents_with_metadata(spark, folder):
    """Mapping documents of one system, whole, found by their metadata, each with the question that asks for it."""
    c = view(spark, folder, "component_schemas").select(
        "component_id", F.col("component_id").alias("mapping_id"), F.col("name").alias("source_column"), F.col("input_dataset").alias("source_table"), F.col("system").alias("source_system"),
        F.lit("*").alias("target_column"), F.col("output_dataset").alias("target_table"), F.col("logic").alias("rule"), F.col("in_spec").alias("source_type"), F.col("out_spec").alias("target_type"))
    docs = dc.where_meta(dc.to_documents(c, "sttm", "component_id", metadata=True), {"source_system": "hadoop"})
    meta = lambda k: F.col("metadata")[k].alias(k)
    question = dc.sttm_question(meta("source_table"), meta("target_system"), meta("name"))
    return docs.select("id", "doc_type", "content", meta("name"), meta("source_table"), meta("target_system"), question.alias("question"))


@query("to_documents_transformation", views=("scripts",), oracle=f"""
SELECT CAST(script_id AS VARCHAR) AS id, 'transformation' AS doc_type, concat('Transformation: filter', chr(10), 'Code: ', x, chr(10), 'Condition: ', regexp_extract(x, {lit(pig.STATEMENTS['filter'])}, 3)) AS content
FROM (SELECT script_id, unnest(regexp_extract_all(content, {lit(pig.STATEMENTS['filter'])}, 0)) AS x FROM scripts) s
""")
def to_documents_transformation(spark, folder):
    steps = pig.pig_transformations(view(spark, folder, "scripts").select(F.col("script_id").cast("string").alias("script_id"), "content"))
    steps = steps.filter("step_type = 'filter'").withColumn("kind", F.col("step_type"))
    return dc.to_documents(steps, "transformation", "script_id", max_items=5, max_chars=300, max_params=10)


@query("to_documents_lineage", views=("scripts",), oracle="""
SELECT CAST(script_id AS VARCHAR) AS id, 'lineage' AS doc_type, unnest([concat('Lineage: pass_through', chr(10), 'Source: k', chr(10), 'Target: k'), concat('Lineage: calculated', chr(10), 'Source: calculated', chr(10), 'Target: w')]) AS content
FROM scripts WHERE system = 'abinitio'
""")
def to_documents_lineage(spark, folder):
    rows = pig.column_lineage(view(spark, folder, "scripts").select(F.col("script_id").cast("string").alias("script_id"), "content"))
    return dc.to_documents(rows, "lineage", "script_id", max_items=5, max_chars=300, max_params=10)


@query("where_meta", oracle="SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src8'")
def where_meta(spark, folder):
    docs = table(spark, folder, "documents").withColumn("metadata", F.create_map(F.lit("origin"), F.col("source")))
    return dc.where_meta(docs, {"lang": "en", "origin": "src8"}).select("doc_id", "lang", "source")


@query("where_any", oracle="SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src8', 'src9')")
def where_any(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return dc.where_any(docs, ["en", "de"], ["src1", "src8", "src9"], "lang", "source")


@query("clean_docs", oracle="""
SELECT doc_id AS id, left(text, 500) AS title, md5(left(text, 50000)) AS content, length(text) > 50000 AS truncated FROM documents WHERE text <> ''
""")
def clean_docs(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("text").alias("content"))
    return dc.clean_docs(docs, 500, 50_000).withColumn("content", F.md5("content"))


def _included(spark, folder):
    p = table(spark, folder, "part").filter(F.col("p_brand").isin("Brand#1", "Brand#2"))
    return p.groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("graph")).agg(F.min(F.concat(F.lit("module_"), "p_brand")).alias("module"))


def _graph_files(spark, folder):
    p = table(spark, folder, "part")
    ext = F.when(F.col("p_partkey") % 3 == 0, ".mp").when(F.col("p_partkey") % 3 == 1, ".plan").otherwise(".pset")
    return p.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ext).alias("name"))


_GF = "gf AS (SELECT p_partkey, concat(replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN '.mp' WHEN 1 THEN '.plan' ELSE '.pset' END) AS name, replace(p_name, ' ', '_') AS graph FROM part), inc AS (SELECT replace(p_name, ' ', '_') AS graph, min(concat('module_', p_brand)) AS module FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY 1)"


@query("include_graphs", oracle=f"WITH {_GF} SELECT p_partkey, name, graph, module FROM gf JOIN inc USING (graph)")
def include_graphs(spark, folder):
    return dc.include_graphs(_graph_files(spark, folder), _included(spark, folder))


@query("module_of", oracle=f"WITH {_GF} SELECT p_partkey, name, graph, coalesce(module, 'Unknown') AS module FROM gf LEFT JOIN inc USING (graph)")
def module_of(spark, folder):
    return dc.module_of(_graph_files(spark, folder), _included(spark, folder))


@query("upsert_docs", oracle="""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE concat('labelled ', CAST(quality AS VARCHAR)) END AS title, CAST(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS BIGINT) AS version
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def upsert_docs(spark, folder):
    """Labels arrive as new versions of the documents they belong to."""
    old = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("title"), F.lit(1).alias("version"))
    new = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("labelled "), F.col("quality").cast("string")).alias("title"), F.lit(2).alias("version"))
    return dc.upsert_docs(old, new, "doc_id", "version")


# --- retrieval -----------------------------------------------------------------------------------

def _vectors(spark, folder):
    """Embeddings as documents: type and system follow from the label and the id."""
    e = table(spark, folder, "embeddings")
    kind = F.when(F.col("label") % 3 == 0, "process").when(F.col("label") % 3 == 1, "sttm").otherwise("gap")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label",
                    kind.alias("doc_type"), F.when(F.col("vec_id") % 2 == 0, "hadoop").otherwise("databricks").alias("system"))


def _centres(spark, folder):
    """One query vector per label: the mean of its embeddings, to six digits."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return mean.groupBy(F.col("label").alias("query_id")).agg(  # one entry per dimension
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


VEC = """
vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS BIGINT) AS label, CASE label % 3 WHEN 0 THEN 'process' WHEN 1 THEN 'sttm' ELSE 'gap' END AS doc_type, CASE vec_id % 2 WHEN 0 THEN 'hadoop' ELSE 'databricks' END AS system FROM embeddings),
dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec),
means AS (SELECT label, pos, round(avg(x), 6) AS x FROM dims GROUP BY label, pos),
centres AS (SELECT label AS query_id, list(x ORDER BY pos) AS v FROM means GROUP BY label),
dist AS (SELECT query_id, id, doc_type, system, round(list_sum(list_transform(list_zip(c.v, vec.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS distance FROM centres c, vec)"""


def _ranked(where="", part="query_id", k=5, extra=""):
    return (f"SELECT query_id, id, round(distance, 6) AS distance, CAST(rk AS BIGINT) AS rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY distance, id) AS rk "
            f"FROM dist {where}) z WHERE rk <= {k}")


@query("vector_search", oracle=f"WITH {VEC} {_ranked(chr(32) + 'WHERE system = ' + lit('hadoop'))}")
def vector_search(spark, folder):
    docs = dc.where_meta(_vectors(spark, folder), {"system": "hadoop"})
    return se.vector_search(docs, _centres(spark, folder), 5)


@query("vector_search_cosine", oracle=f"""
WITH {VEC}, cs AS (SELECT query_id, id, round(1 - list_sum(list_transform(list_zip(c.v, vec.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(c.v, lambda a: a * a))) * sqrt(list_sum(list_transform(vec.v, lambda a: a * a)))), 9) AS distance FROM centres c, vec)
SELECT query_id, id, round(distance, 6) AS distance, CAST(rk AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM cs) z WHERE rk <= 3
""")
def vector_search_cosine(spark, folder):
    return se.vector_search(_vectors(spark, folder), _centres(spark, folder), 3, metric="cosine")


@query("multi_search", oracle=f"WITH {VEC} {_ranked(part='query_id, doc_type', k=4, extra=', doc_type')}")
def multi_search(spark, folder):
    return se.multi_search(_vectors(spark, folder), _centres(spark, folder), 4, "doc_type")


@query("compare_hits", oracle=f"WITH {VEC} {_ranked(part='query_id, system', k=3, extra=', system')}")
def compare_hits(spark, folder):
    return se.compare_hits(_vectors(spark, folder), _centres(spark, folder), "hadoop", "databricks")


@query("find_processes", oracle=f"WITH {VEC} {_ranked(where='WHERE doc_type = ' + lit('process'))}")
def find_processes(spark, folder):
    return se.find_documents(_vectors(spark, folder), _centres(spark, folder), 5, "process")


@query("find_gaps", oracle=f"WITH {VEC} {_ranked(where='WHERE doc_type = ' + lit('gap') + ' AND system = ' + lit('databricks'))}")
def find_gaps(spark, folder):
    return se.find_documents(_vectors(spark, folder), _centres(spark, folder), 5, "gap", "databricks")


@query("find_sttm", oracle=f"WITH {VEC} {_ranked(where='WHERE doc_type = ' + lit('sttm'))}")
def find_sttm(spark, folder):
    return se.find_documents(_vectors(spark, folder), _centres(spark, folder), 5, "sttm")


@query("ann_search")
def ann_search(spark, folder):
    """Approximate nearest embeddings of the label centres (no SQL form)."""
    return se.ann_search(_vectors(spark, folder), _centres(spark, folder), 5, max_distance=2.0)


@query("vector_index", oracle=f"""
WITH {VEC} SELECT count(*) AS stored, (SELECT count(*) * 5 FROM centres WHERE query_id % 2 = 1) AS asked, true AS recall_90, true AS distances_exact FROM vec
""")
def vector_index(spark, folder):
    """A kept approximate index over all embeddings, tuned with the even labels' centres and held against exact search with the odd ones'."""
    docs, centres = _vectors(spark, folder).select("id", "vector"), _centres(spark, folder)
    queries = centres.where("query_id % 2 = 1")
    index = se.VectorIndex(spark, scratch(spark, "vector-index"))
    index.build(docs, lists=32)
    found = index.search(queries, 5, index.tune(centres.where("query_id % 2 = 0"), 5, 0.98)).select("query_id", "id", "distance")
    exact = se.vector_search(docs, queries, 5).select("query_id", "id", F.col("distance").alias("exact"))
    met = exact.join(found, ["query_id", "id"], "left").agg(
        F.count("*").alias("asked"), (F.count("distance") >= 0.9 * F.count("*")).alias("recall_90"),
        (F.coalesce(F.max(F.abs(F.col("exact") - F.col("distance"))), F.lit(0.0)) < 1e-6).alias("distances_exact"))
    return index.rows().agg(F.count("*").alias("stored")).crossJoin(met)  # one row each


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


@query("vectorize", oracle=f"""
WITH t AS (SELECT doc_id AS id, unnest({_TOK}) AS term FROM documents), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
d AS (SELECT term, ln((CAST((SELECT count(*) FROM documents) AS DOUBLE) + 1) / (count(*) + 1)) AS idf FROM c GROUP BY term),
r AS (SELECT id, term, tf * idf AS w FROM c JOIN d USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM r GROUP BY id)
SELECT id, term, round(w / norm, 6) AS weight FROM r JOIN n USING (id) WHERE norm > 0
""")
def vectorize(spark, folder):
    return se.vectorize(texts(spark, folder), key="doc_id")


@query("hashed_vectors")
def hashed_vectors(spark, folder):
    """Fixed-size text vectors; the sum of squares shows that each is normalised (no SQL form)."""
    from pyspark.ml.functions import vector_to_array
    docs = se.hashed_vectors(texts(spark, folder).select("doc_id", "text"), size=1024)
    squares = F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, x: a + x * x)
    return docs.select("doc_id", F.round(squares, 6).alias("squares"))


_PHRASES = [(0, "the and of that"), (1, "der die und das"), (2, "que los las una"), (3, "les des une dans"), (4, "report tion ing")]
_PH = "ph AS (SELECT CAST(query_id AS BIGINT) AS query_id, text FROM (VALUES " + ", ".join(f"({i}, {lit(t)})" for i, t in _PHRASES) + ") p(query_id, text))"
BM = f"""{_PH}, qt AS (SELECT DISTINCT query_id, unnest(string_split(text, ' ')) AS term FROM ph),
tk AS (SELECT doc_id AS id, {_TOK} AS ts FROM documents), av AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
hit AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) u WHERE term IN (SELECT term FROM qt) GROUP BY id, dl, term),
idf AS (SELECT term, ln(1 + ((SELECT n FROM av) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM hit GROUP BY term),
bm AS (SELECT query_id, id, round(sum(idf * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM av)))), 6) AS score FROM hit JOIN idf USING (term) JOIN qt USING (term) GROUP BY query_id, id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM bm)"""


def _phrases(spark):
    return spark.createDataFrame(_PHRASES, "query_id int, text string")


def _text_docs(spark, folder):
    return texts(spark, folder).select(F.col("doc_id").alias("id"), "text")


@query("bm25", oracle=f"WITH {BM} SELECT query_id, id, score, rk AS rank FROM bmr WHERE rk <= 10")
def bm25(spark, folder):
    return se.bm25(_text_docs(spark, folder), _phrases(spark), 10)


def _text_index(spark, folder):
    """The documents as a kept index: a first batch lacks some and holds old texts of others, a second one brings these."""
    docs, index = _text_docs(spark, folder), se.TextIndex(spark, scratch(spark, "text-index"))
    late, old = F.col("id") % 7 == 0, F.col("id") % 11 == 0
    index.add(docs.where(~late).withColumn("text", F.when(old, F.concat(F.lit("the und "), "text", F.lit(" the"))).otherwise(F.col("text"))), 1)
    index.add(docs.where(late | old), 2)
    return index


@query("bm25_index", oracle=f"WITH {BM} SELECT query_id, id, score, rk AS rank FROM bmr WHERE rk <= 10")
def bm25_index(spark, folder):
    """The same ranking from a kept inverted index, after a batch that replaces texts."""
    return _text_index(spark, folder).search(_phrases(spark), 10)


RANKED = f"""
WITH {BM}, {VEC}, both_ids AS (SELECT id FROM vec JOIN documents ON doc_id = id),
tk2 AS (SELECT tk.* FROM tk JOIN both_ids USING (id)), av2 AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk2),
hit2 AS (SELECT hit.* FROM hit JOIN both_ids USING (id)),
idf2 AS (SELECT term, ln(1 + ((SELECT n FROM av2) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM hit2 GROUP BY term),
bm2 AS (SELECT query_id, id, round(sum(idf * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM av2)))), 6) AS score FROM hit2 JOIN idf2 USING (term) JOIN qt USING (term) GROUP BY query_id, id),
tr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM bm2),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM dist WHERE query_id IN (SELECT query_id FROM ph) AND id IN (SELECT id FROM both_ids)),"""
FUSED = "SELECT query_id, id, round(score, 6) AS score, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM fu) z WHERE rk <= 10"


def _hybrid(spark, folder, depth=None):
    docs = _text_docs(spark, folder).join(_vectors(spark, folder).select("id", "vector"), "id")
    queries = _phrases(spark).join(_centres(spark, folder), "query_id")
    return se.hybrid_search(docs, queries, 10, depth=depth)


@query("hybrid_search", oracle=f"""{RANKED}
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM (SELECT * FROM tr WHERE rk <= 50 UNION ALL SELECT * FROM vr WHERE rk <= 50) a GROUP BY query_id, id)
{FUSED}
""")
def hybrid_search(spark, folder):
    """Fuses the first 50 of each ranking."""
    return _hybrid(spark, folder, depth=50)


@query("hybrid_search_whole", oracle=f"""{RANKED}
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM (SELECT * FROM tr UNION ALL SELECT * FROM vr) a GROUP BY query_id, id)
{FUSED}
""")
def hybrid_search_whole(spark, folder):
    """Fuses the whole rankings; k is the only limit."""
    return _hybrid(spark, folder)


@query("topk_per_group", oracle="""
SELECT source, doc_id, n_chars, rk AS rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) z WHERE rk <= 5
""")
def topk_per_group(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return se.topk_per_group(docs, 5, ["source"], [F.desc("n_chars"), "doc_id"])


@query("build_context", oracle=f"""
WITH {BM}, h AS (SELECT query_id, id, rk, lang, source, text FROM bmr JOIN documents ON doc_id = id WHERE rk <= 8)
SELECT query_id, md5(string_agg(concat('[Source ', CAST(rk AS VARCHAR), '] Type: ', lang, ' | System: ', source, chr(10), 'Content: ', left(text, 500), chr(10), '---'), chr(10) ORDER BY rk) FILTER (rk <= 5)) AS context,
  count(*) AS total_results, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM h GROUP BY query_id
""")
def build_context(spark, folder):
    hits = se.bm25(_text_docs(spark, folder), _phrases(spark), 8)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("doc_type"), F.col("source").alias("system"), F.col("text").alias("content"))
    return se.build_context(hits.join(docs, "id"), 5, 500).withColumn("context", F.md5("context"))


@query("merge_hits", views=("scripts",), oracle="""
WITH c AS (SELECT concat('f', CAST(l_partkey AS VARCHAR)) AS path, max(l_discount * 10) AS chunk, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS path, max(0.5::DOUBLE) AS by_name FROM part WHERE p_size % 2 = 0 GROUP BY 1),
p AS (SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS path, max(p_size / 60.0::DOUBLE) AS by_pattern FROM part WHERE p_size % 3 = 0 GROUP BY 1),
k AS (SELECT path FROM c UNION SELECT path FROM b UNION SELECT path FROM p)
SELECT path, round(CASE WHEN coalesce(chunk, by_name) IS NULL THEN by_pattern WHEN by_pattern IS NULL THEN coalesce(chunk, by_name) ELSE least((coalesce(chunk, by_name) + by_pattern) / 2 * 1.2::DOUBLE, 1.0) END, 6) AS score, coalesce(n, 0) AS matched_chunks
FROM k LEFT JOIN c USING (path) LEFT JOIN b USING (path) LEFT JOIN p USING (path)
""")
def merge_hits(spark, folder):
    f = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("path")
    chunk = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(f("l_partkey"), (F.col("l_discount") * 10).alias("score"))
    part = table(spark, folder, "part")
    names = part.filter("p_size % 2 = 0").select(f("p_partkey"), F.lit(0.5).alias("score"))
    patterns = part.filter("p_size % 3 = 0").select(f("p_partkey"), (F.col("p_size") / F.lit(60.0)).alias("score"))
    return se.merge_hits(chunk, names, patterns)


# --- sinks and indexing ------------------------------------------------------------------------------

def write_scripts(scripts, path):
    """(place, script_id, value) as one file per place and id, a line per row; rows of an id follow each other in a partition.

    Spark's writer takes many times longer per file. Where the shared folder is a local one, tasks write the files
    themselves, into folders of bounded number; elsewhere Spark's writer does.
    """
    folder = scripts.sparkSession.sparkContext.getCheckpointDir()
    if urlparse(folder).scheme not in ("", "file"):
        scripts.write.partitionBy("place", "script_id").text(path)
        return
    root = urlparse(path).path

    def files(batches):
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("place", "script_id", "value"))))
        written = 0
        for (place, key), lines in groupby(rows, lambda r: r[:2]):
            where = f"{root}/place={place}/part={0 if key is None else key % 1000}"
            os.makedirs(where, exist_ok=True)
            with open(f"{where}/script_id={'__HIVE_DEFAULT_PARTITION__' if key is None else key}.txt", "w", encoding="utf-8", newline="") as out:
                out.writelines(f"{line[2] or ''}\n" for line in lines)
            written += 1
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    scripts.mapInArrow(files, "written long").agg(F.sum("written")).collect()  # one row


@query("scan_files", views=("scripts",), oracle="""
SELECT script_id, md5(concat(replace(content, chr(10), ' '), chr(10))) AS content_hash FROM scripts WHERE script_id % 4 <> 0
""")
def scan_files(spark, folder):
    """Each script written as a file and scanned; one in four lies in a folder that is skipped."""
    path = scratch(spark, "estate")
    place = F.when(F.col("script_id") % 8 == 0, "target").when(F.col("script_id") % 4 == 0, "build").otherwise("jobs")
    scripts = view(spark, folder, "scripts").select("script_id", place.alias("place"), F.translate("content", "\n", " ").alias("value"))
    write_scripts(scripts.repartition("script_id").sortWithinPartitions("script_id"), path)
    found = src.scan_files(spark, path, "hadoop", exts=[".txt"], skip=["place=target", "place=build"])
    return found.select(F.regexp_extract("path", "script_id=([0-9]+)", 1).cast("int").alias("script_id"), F.md5("content").alias("content_hash"))


@query("write_report_json", views=("gaps",), oracle="SELECT gap_id, gap_type, severity, source_system FROM gaps")
def write_report_json(spark, folder):
    gaps, path = view(spark, folder, "gaps"), scratch(spark, "report-json")
    sinks.write_report(gaps, path, "json")
    return spark.read.schema(gaps.schema).json(path)


@query("write_report_csv", views=("gaps",), oracle="SELECT gap_id, gap_type, severity, source_system FROM gaps")
def write_report_csv(spark, folder):
    gaps, path = view(spark, folder, "gaps"), scratch(spark, "report-csv")
    sinks.write_report(gaps, path, "csv")
    return spark.read.schema(gaps.schema).csv(path, header=True)


@query("write_report_markdown", views=("gaps",), oracle="""
SELECT concat('### Gap: ', gap_id) AS line, count(*) AS n FROM gaps GROUP BY 1 UNION ALL SELECT concat('- **severity**: ', severity), count(*) FROM gaps GROUP BY 1
UNION ALL SELECT concat('- **gap_type**: ', gap_type), count(*) FROM gaps GROUP BY 1 UNION ALL SELECT concat('- **source_system**: ', source_system), count(*) FROM gaps GROUP BY 1
""")
def write_report_markdown(spark, folder):
    path = scratch(spark, "report-md")
    sinks.write_report(view(spark, folder, "gaps"), path, "markdown", title="Gap")
    return spark.read.text(path).filter("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("write_by_type", views=("gaps",), oracle="SELECT gap_type, severity, count(*) AS n FROM gaps GROUP BY gap_type, severity")
def write_by_type(spark, folder):
    path = scratch(spark, "gaps-by-type")
    sinks.write_by_type(view(spark, folder, "gaps"), path)
    return spark.read.parquet(path).groupBy("gap_type", "severity").agg(F.count("*").alias("n"))


@query("cap_rows", oracle="""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25000
""")
def cap_rows(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sinks.cap_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 25_000)


def _indexed(spark, folder):
    """Three scans of the documents as files; returns the index folder.

    The first scan lacks one file in seven and finds one in fifty empty. In the second, the missing
    files are there with old time stamps, and one file in eleven has been rewritten. Before the third, half
    of these have been restored, with the size and time that they had at first.
    """
    out = scratch(spark, "index")
    d = F.col("doc_id")
    docs = table(spark, folder, "documents").select(
        "doc_id", d.cast("string").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"),
        F.when(d % 50 != 0, F.col("text")).alias("content"), d.cast("string").alias("path"), F.length("text").alias("size"))
    first = docs.filter(d % 7 != 0).withColumn("modified", F.lit(20240101)).withColumn("version", F.lit(1))
    rewritten = d % 11 == 0
    second = docs.withColumn("modified", F.when(rewritten, 20240301).when(d % 7 == 0, 20200101).otherwise(20240101)) \
        .withColumn("version", F.when(rewritten, 2).otherwise(1)) \
        .withColumn("content", F.when(rewritten, F.concat("content", F.lit(" v2"))).otherwise(F.col("content")))
    restored = docs.withColumn("modified", F.when(d % 7 == 0, 20200101).otherwise(20240101)).withColumn("version", F.lit(1))
    third = second.where(d % 22 != 0).unionByName(restored.where(d % 22 == 0))
    for scan in (first, second, third):
        inc.index_changes(scan.withColumn("file_key", inc.file_key()).drop("doc_id", "path", "size", "modified"), out)
    return out


@query("incremental_index", oracle="""
SELECT CAST(doc_id AS VARCHAR) AS id, concat(lang, ' ', source) AS title,
  md5(CASE WHEN doc_id % 11 = 0 AND doc_id % 22 <> 0 THEN concat(text, ' v2') ELSE text END) AS content_hash, CASE WHEN doc_id % 11 = 0 AND doc_id % 22 <> 0 THEN 2 ELSE 1 END AS version
FROM documents WHERE doc_id % 50 <> 0 AND text <> ''
""")
def incremental_index(spark, folder):
    docs = inc.indexed_docs(spark, _indexed(spark, folder))
    return docs.select("id", "title", F.md5("content").alias("content_hash"), "version")


@query("retry_failed", oracle="SELECT doc_id AS id, lang FROM documents WHERE doc_id % 50 = 0 OR text = ''")
def retry_failed(spark, folder):
    failed = inc.failed_docs(spark, _indexed(spark, folder)).select(F.col("id").cast("bigint").alias("id"))
    return inc.retry_failed(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang"), failed)


@query("changed_files", views=("scripts",), oracle="""
SELECT script_id, path FROM scripts WHERE script_id % 11 = 0 OR length(content) % 7 = 0
""")
def changed_files(spark, folder):
    """Between two scans one file in eleven got a new time stamp, one size in seven is new."""
    now = view(spark, folder, "scripts").select("script_id", "path", F.length("content").alias("size"), F.lit(20240101).alias("modified"))
    keyed = lambda df: df.withColumn("file_key", inc.file_key())
    previous = now.filter("size % 7 <> 0").withColumn("modified", F.when(F.col("script_id") % 11 == 0, 20231231).otherwise(F.col("modified")))
    return inc.changed_files(keyed(previous), keyed(now)).select("script_id", "path")
