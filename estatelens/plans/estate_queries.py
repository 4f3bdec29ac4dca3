"""Registered queries for mappings of columns, gaps, sizing and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions import text as tx
from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage, ranged
from estatelens.operators import gaps as gp
from estatelens.operators import matching as mt
from estatelens.operators import pig_scripts as pig
from estatelens.operators import rollups as ru
from estatelens.operators import sizing as sz
from estatelens.operators import spark_scripts as spk
from estatelens.operators import sql_scripts as sql
from estatelens.operators import sttm as st
from estatelens.operators.scripts import path_group
from estatelens.operators.workflow_mapping import order_by_severity
from estatelens.plans.mapping_queries import EQUIVALENT, PROCESS_PAIRS, SRC, TGT, best_oracle, equivalent_component, process_pairs
from estatelens.plans.registry import lit, lit_list, query
from estatelens.plans.views import table, view


COMPONENTS_PER_TASK = 250_000  # about four mappings each


def fields(spec: str):
    """Array of (name, type) from a `name:type,...` text; empty text gives no fields."""
    parts = F.filter(F.split(spec, ","), lambda x: x != "")
    return F.transform(parts, lambda p: F.struct(
        F.split(p, ":").getItem(0).alias("name"), F.split(p, ":").getItem(1).alias("type")))


def components(spark, folder, dealt=lambda rows: rows):
    """Components with arrays of fields; `dealt` moves their rows before the arrays are made."""
    return dealt(view(spark, folder, "component_schemas")).select(
        "component_id", "process_id", "name", "system", fields("in_spec").alias("in_fields"), fields("out_spec").alias("out_fields"),
        "logic", "input_dataset", "output_dataset")


# Output fields in long form, with the input field of the same name, for comparison only.
OUT = """
outs AS (SELECT component_id, process_id, name, system, in_spec, out_spec, logic, input_dataset, output_dataset, unnest(string_split(out_spec, ',')) AS f, generate_subscripts(string_split(out_spec, ','), 1) AS pos FROM component_schemas WHERE out_spec <> ''),
o AS (SELECT *, split_part(f, ':', 1) AS target_column, split_part(f, ':', 2) AS raw_type,
  list_filter(string_split(in_spec, ','), lambda x: in_spec <> '' AND lower(split_part(x, ':', 1)) = lower(split_part(f, ':', 1)))[1] AS hit FROM outs)"""
RULE = """CASE WHEN logic = '' THEN CASE WHEN hit IS NULL THEN 'Derived column' ELSE 'Direct mapping' END
  WHEN contains(logic, target_column) THEN left(trim(list_filter(string_split(logic, chr(10)), lambda l: contains(l, target_column))[1]), 200) ELSE left(logic, 200) END"""
HIVE = "CASE " + " ".join(f"WHEN lower({{0}}) = '{k}' THEN '{v}'" for k, v in vocab.HIVE_DATATYPES.items()) + " ELSE 'unknown' END"
STTM = f"""{OUT}, sttm AS (
  SELECT component_id, process_id, name, system, '' AS source_table, coalesce(split_part(hit, ':', 1), '') AS source_column, coalesce(split_part(hit, ':', 2), '') AS source_type,
    '' AS target_table, target_column, raw_type AS target_type, CASE WHEN hit IS NULL THEN 'derived' ELSE 'direct' END AS mapping_type, {RULE} AS rule, CAST(0 AS BIGINT) AS processing_order,
    left(md5(concat(component_id, '_', target_column)), 16) AS mapping_id FROM o WHERE in_spec <> ''
  UNION ALL SELECT component_id, process_id, name, system, '', '', '', output_dataset, target_column, {HIVE.format('raw_type')}, 'output_definition', '', pos,
    left(md5(concat(component_id, '_field_', CAST(pos - 1 AS VARCHAR))), 16) FROM o WHERE in_spec = ''
  UNION ALL SELECT component_id, process_id, name, system, input_dataset, '*', '', output_dataset, '*', '', 'component_level', CASE logic WHEN '' THEN 'Component transformation' ELSE logic END, 0,
    left(md5(concat(component_id, '_basic')), 16) FROM component_schemas WHERE in_spec = '' AND out_spec = '')"""


@query("component_mappings", views=("component_schemas",), oracle=f"WITH {STTM} SELECT * FROM sttm")
def component_mappings(spark, folder):
    return st.component_mappings(components(spark, folder))


@query("map_schemas", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT component_id, target_column, source_column, mapping_type, rule FROM sttm WHERE mapping_type IN ('direct', 'derived')
""")
def map_schemas(spark, folder):
    rows = components(spark, folder).filter((F.size("in_fields") > 0) & (F.size("out_fields") > 0))
    return st.component_mappings(rows).select("component_id", "target_column", "source_column", "mapping_type", "rule")


@query("basic_mappings", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT component_id, source_table, target_table, target_column, target_type, processing_order, mapping_type FROM sttm WHERE mapping_type IN ('output_definition', 'component_level')
""")
def basic_mappings(spark, folder):
    rows = components(spark, folder).filter(F.size("in_fields") == 0)
    return st.component_mappings(rows).select(
        "component_id", "source_table", "target_table", "target_column", "target_type", "processing_order", "mapping_type")


_LINKS = f"""{PROCESS_PAIRS},
links AS (SELECT DISTINCT source_process, target_process, s.component_id AS source_component, t.component_id AS target_component, s.out_spec AS ss, CASE t.in_spec WHEN '' THEN t.out_spec ELSE t.in_spec END AS ts
  FROM component_schemas s JOIN pairs ON s.process_id = source_process JOIN component_schemas t ON t.process_id = target_process AND t.input_dataset = s.output_dataset),
f AS (SELECT *, unnest(string_split(ts, ',')) AS tf FROM links WHERE ss <> '' AND ts <> ''),
h AS (SELECT *, list_filter(string_split(ss, ','), lambda x: lower(split_part(x, ':', 1)) = lower(split_part(tf, ':', 1)))[1] AS hit FROM f)"""


def _linked(spark, folder):
    return components(spark, folder).withColumn("inputs", F.array("input_dataset")).withColumn("outputs", F.array("output_dataset"))


@query("cross_process_classes", views=("processes", "component_schemas"), oracle=f"""
WITH {_LINKS} SELECT source_process, target_process, coalesce(split_part(hit, ':', 1), '') AS source_column, split_part(tf, ':', 1) AS target_column, hit IS NULL AS is_derived, count(*) AS n_pairs
FROM h GROUP BY 1, 2, 3, 4, 5
""")
def cross_process_classes(spark, folder):
    """Component pairs per process pair and column mapping."""
    comps = cut_lineage(_linked(spark, folder))
    rows = st.cross_process_classes(process_pairs(spark, folder), comps, comps)
    return rows.groupBy("source_process", "target_process", "source_column", "target_column", "is_derived").agg(
        F.sum("n_pairs").alias("n_pairs"))


@query("cross_process_mappings", views=("processes", "component_schemas"), oracle=f"""
WITH {_LINKS}
SELECT source_component, target_component, coalesce(split_part(hit, ':', 1), '') AS source_column, coalesce(split_part(hit, ':', 2), '') AS source_type,
  split_part(tf, ':', 1) AS target_column, split_part(tf, ':', 2) AS target_type, hit IS NULL AS is_derived,
  left(md5(concat(source_component, '_', target_component, '_', split_part(tf, ':', 1))), 16) AS mapping_id, 'cross_system' AS mapping_type FROM h
""")
def cross_process_mappings(spark, folder):
    comps = _linked(spark, folder)
    return st.cross_process_mappings(process_pairs(spark, folder), comps, comps)


_REPORT_SQL = f"""
WITH {STTM}, n AS (SELECT *, row_number() OVER (ORDER BY component_id, processing_order, target_column) AS no FROM sttm)
SELECT concat('sttm_', CASE WHEN no < 100000 THEN lpad(CAST(no AS VARCHAR), 5, '0') ELSE CAST(no AS VARCHAR) END) AS "STTM_ID", process_id AS "Process_Name", system AS "System", '' AS "Business_Domain",
  source_table AS "Source_Table", source_column AS "Source_Column", source_type AS "Source_Datatype", '' AS "Source_Description", 'N' AS "Source_Is_PK", 'Y' AS "Source_Is_Nullable",
  target_table AS "Target_Table", target_column AS "Target_Column", target_type AS "Target_Datatype", '' AS "Target_Description", 'N' AS "Target_Is_PK", 'Y' AS "Target_Is_Nullable",
  processing_order AS "Processing_Order", CASE rule WHEN '' THEN 'Direct mapping' ELSE rule END AS "Transformation_Rule", '' AS "Business_Rule", '' AS "Data_Quality_Rule",
  mapping_type AS "Mapping_Type", 1.0::DOUBLE AS "Mapping_Confidence", '' AS "Notes", '' AS "Tags" FROM n
"""


@query("sttm_report", views=("component_schemas",), oracle=_REPORT_SQL)
def sttm_report(spark, folder):
    in_order = components(spark, folder, lambda rows: ranged(rows, COMPONENTS_PER_TASK, "component_id"))
    return st.sttm_report(st.component_mappings(in_order),
                          ["component_id", "processing_order", "target_column"], process_name="process_id")


@query("processing_order", views=("component_schemas",), oracle=f"""
WITH {OUT} SELECT component_id, pos AS processing_order, target_column FROM o
""")
def processing_order(spark, folder):
    return st.processing_order(components(spark, folder))


@query("sttm_summary", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT count(*) AS total_mappings, count(*) FILTER (mapping_type = 'direct') AS direct_mappings, count(*) FILTER (mapping_type = 'derived') AS derived_mappings,
  count(*) FILTER (mapping_type = 'lookup') AS lookup_mappings, count(*) FILTER (mapping_type = 'calculated') AS calculated_mappings,
  count(DISTINCT nullif(source_table, '')) AS source_tables, count(DISTINCT nullif(target_table, '')) AS target_tables FROM sttm
""")
def sttm_summary(spark, folder):
    return st.sttm_summary(st.component_mappings(components(spark, folder)))


@query("logic_level", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT rule AS logic, count(*) AS field_count, count(DISTINCT nullif(source_column, '')) AS source_fields,
  CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS complexity FROM sttm GROUP BY rule
""")
def logic_level(spark, folder):
    return st.logic_level(st.component_mappings(components(spark, folder)))


@query("logic_fields", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT DISTINCT rule AS logic, source_column AS source_field FROM sttm WHERE source_column <> ''
""")
def logic_fields(spark, folder):
    return st.logic_fields(st.component_mappings(components(spark, folder)))


@query("column_level", views=("component_schemas",), oracle=f"""
WITH {STTM} SELECT target_column AS column_name, target_table, source_column AS source_columns, source_table AS source_dataset, rule AS transformation_logic, target_type AS data_type, processing_order FROM sttm
""")
def column_level(spark, folder):
    return st.column_level(st.component_mappings(components(spark, folder)))


def _scored_fields(spark, folder):
    """Labelled documents as mapping rows: quality gives the confidence, toxic the flag."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return rows.select("doc_id", (F.lit(0.6) + F.col("quality") * 0.25).alias("confidence"),
                       (F.col("toxic") == 1).alias("contains_pii"), F.col("lang").alias("field_type"),
                       F.col("source").alias("target_table"))


@query("filter_sttm", oracle="""
SELECT doc_id, round(0.6::DOUBLE + quality * 0.25::DOUBLE, 6) AS confidence, toxic = 1 AS contains_pii, lang AS field_type, source AS target_table
FROM labels JOIN documents USING (doc_id) WHERE 0.6::DOUBLE + quality * 0.25::DOUBLE >= 0.6 AND lang IN ('en', 'de')
""")
def filter_sttm(spark, folder):
    return st.filter_sttm(_scored_fields(spark, folder), min_confidence=0.6, field_types=["en", "de"])


@query("filter_sttm_pii", oracle="""
SELECT doc_id, lang AS field_type FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
""")
def filter_sttm_pii(spark, folder):
    return st.filter_sttm(_scored_fields(spark, folder), pii_only=True).select("doc_id", "field_type")


@query("sttm_quality", oracle="""
SELECT round(avg(0.6::DOUBLE + quality * 0.25::DOUBLE), 2) AS confidence, count(*) FILTER (toxic = 1) AS pii_fields, count(DISTINCT source) AS target_tables
FROM labels JOIN documents USING (doc_id)
""")
def sttm_quality(spark, folder):
    return st.sttm_quality(_scored_fields(spark, folder))


# --- steps of the scripts of all systems ------------------------------------------

def steps(spark, folder):
    """Transformation rows of all scripts by the rules of their language, united by name."""
    scripts = view(spark, folder, "scripts").select("script_id", "system", "content")
    one = lambda system, f: f(scripts.filter(F.col("system") == system))
    hive = one("hadoop", sql.sql_transformations).select("script_id", "system", "kind", "condition")
    spark_ = one("databricks", spk.pyspark_transformations).select("script_id", "system", "kind", "condition")
    pig_ = one("abinitio", pig.pig_transformations).select("script_id", "system", F.col("step_type").alias("kind"), "condition")
    return hive.unionByName(spark_, allowMissingColumns=True).unionByName(pig_, allowMissingColumns=True)


_x = lambda p, g=1: f"unnest(regexp_extract_all(content, {lit(p)}, {g}))"
STEPS = f"""
steps AS (
  SELECT script_id, system, 'filter' AS kind, trim({_x(sql.WHERE_CLAUSE)}) AS condition FROM scripts WHERE system = 'hadoop'
  UNION ALL SELECT script_id, system, 'join', {_x(sql.JOIN_CLAUSE, 3)} FROM scripts WHERE system = 'hadoop'
  UNION ALL SELECT script_id, system, 'group_by', CASE WHEN {_x(sql.GROUP_CLAUSE)} IS NULL THEN '' END FROM scripts WHERE system = 'hadoop'
  UNION ALL SELECT script_id, system, 'aggregate', CASE WHEN {_x(sql.AGGREGATE_CALL)} IS NULL THEN '' END FROM scripts WHERE system = 'hadoop'
  UNION ALL SELECT script_id, system, 'filter', trim({_x(spk.FILTER)}) FROM scripts WHERE system = 'databricks'
  UNION ALL SELECT script_id, system, 'join', trim({_x(spk.JOIN, 2)}) FROM scripts WHERE system = 'databricks'
  UNION ALL SELECT script_id, system, 'filter', {_x(pig.STATEMENTS['filter'], 3)} FROM scripts WHERE system = 'abinitio'
  UNION ALL SELECT script_id, system, 'transform', CASE WHEN {_x(pig.STATEMENTS['foreach'])} IS NULL THEN '' END FROM scripts WHERE system = 'abinitio')"""


@query("union_systems", views=("scripts",), oracle=f"WITH {STEPS} SELECT * FROM steps")
def union_systems(spark, folder):
    return steps(spark, folder)


@query("transformation_counts", views=("scripts",), oracle=f"""
WITH {STEPS} SELECT system, script_id, kind, count(*) AS steps FROM steps GROUP BY ROLLUP (system, script_id, kind)
""")
def transformation_counts(spark, folder):
    return gp.transformation_counts(steps(spark, folder))


@query("transformation_gaps", views=("scripts",), oracle=f"""
WITH {STEPS}, c AS (SELECT kind, count(*) FILTER (system = 'hadoop') AS source_count, count(*) FILTER (system = 'databricks') AS target_count FROM steps GROUP BY kind)
SELECT CASE target_count WHEN 0 THEN 'missing_transformation_type' ELSE 'incomplete_transformation_coverage' END AS gap_type, CASE target_count WHEN 0 THEN 'high' ELSE 'medium' END AS severity,
 kind, source_count, target_count, CASE WHEN target_count > 0 THEN round(CAST(target_count AS DOUBLE) / source_count * 100, 2) END AS coverage_percent FROM c WHERE source_count > 0 AND target_count < source_count * 0.5
""")
def transformation_gaps(spark, folder):
    return gp.transformation_gaps(steps(spark, folder), SRC, TGT)


_QC = "len(list_filter(" + lit_list(vocab.QUALITY_WORDS) + ", lambda w: contains(lower(coalesce({0}, '')), w))) > 0"


@query("is_quality_check", views=("scripts",), oracle=f"""
WITH {STEPS} SELECT script_id, condition, {_QC.format('condition')} AS is_check FROM steps WHERE kind = 'filter'
""")
def is_quality_check(spark, folder):
    return steps(spark, folder).filter(F.col("kind") == "filter").select(
        "script_id", "condition", gp.is_quality_check("condition").alias("is_check"))


@query("quality_gaps", views=("scripts",), oracle=f"""
WITH {STEPS}, c AS (SELECT count(*) FILTER (system = 'hadoop') AS s, count(*) FILTER (system = 'databricks') AS t FROM steps WHERE kind = 'filter' AND {_QC.format('condition')})
SELECT CASE WHEN s > 0 AND t = 0 THEN 'missing_data_quality' ELSE 'incomplete_data_quality' END AS gap_type, CASE WHEN s > 0 AND t = 0 THEN 'critical' ELSE 'high' END AS severity, s AS source_checks, t AS target_checks,
 CASE WHEN t > 0 THEN round(CAST(t AS DOUBLE) / s * 100, 2) END AS coverage_percent FROM c WHERE (s > 0 AND t = 0) OR t < s * 0.7
""")
def quality_gaps(spark, folder):
    return gp.quality_gaps(steps(spark, folder), SRC, TGT)


@query("rule_gaps", views=("scripts",), oracle=f"""
WITH {STEPS}, long_lost AS (SELECT DISTINCT condition FROM steps WHERE system = 'hadoop' AND length(condition) > 10 EXCEPT SELECT condition FROM steps WHERE system = 'databricks')
SELECT 'missing_business_logic' AS gap_type, 'high' AS severity, count(*) AS missing_rules, array_to_string(list_sort(list(condition))[1:5], '|') AS sample_rules FROM long_lost
""")
def rule_gaps(spark, folder):
    return gp.rule_gaps(steps(spark, folder), SRC, TGT, sample=5)


@query("missing_rules", views=("scripts",), oracle=f"""
WITH {STEPS} SELECT DISTINCT condition AS rule FROM steps WHERE system = 'databricks' AND length(condition) > 4 EXCEPT SELECT condition FROM steps WHERE system = 'hadoop' AND length(condition) > 4
""")
def missing_rules(spark, folder):
    return gp.missing_rules(steps(spark, folder), "databricks", SRC, min_chars=4)


@query("io_gaps", views=("scripts",), oracle=f"""
WITH io AS (SELECT system, len(list_distinct(list_concat(regexp_extract_all(content, {lit(sql.FROM_TABLE)}, 1), regexp_extract_all(content, {lit(sql.JOIN_TABLE)}, 1)))) AS r,
   len(list_distinct(list_concat(regexp_extract_all(content, {lit(sql.INSERT_TABLE)}, 1), regexp_extract_all(content, {lit(sql.CREATE_TABLE)}, 1)))) AS w FROM scripts),
t AS (SELECT CAST(sum(r) FILTER (system = 'hadoop') AS BIGINT) AS si, CAST(sum(r) FILTER (system = 'databricks') AS BIGINT) AS ti, CAST(sum(w) FILTER (system = 'hadoop') AS BIGINT) AS so, CAST(sum(w) FILTER (system = 'databricks') AS BIGINT) AS t_o FROM io)
SELECT 'incomplete_inputs' AS gap_type, si AS source_total, ti AS target_total, 'medium' AS severity FROM t WHERE si > 0 AND ti < si * 0.5
UNION ALL SELECT 'incomplete_outputs', so, t_o, 'medium' FROM t WHERE so > 0 AND t_o < so * 0.5
""")
def io_gaps(spark, folder):
    scripts = view(spark, folder, "scripts").select("system", sql.sql_reads().alias("reads"), sql.sql_writes().alias("writes"))
    return gp.io_gaps(scripts, SRC, TGT)


@query("missing_processes", views=("processes", "components"), oracle=f"""
SELECT left(md5(concat('missing_', process_id)), 16) AS gap_id, 'missing_process' AS gap_type, 'critical' AS severity, process_id FROM processes
WHERE system = 'hadoop' AND process_id NOT IN (SELECT source_id FROM ({best_oracle(0.865)}) b)
""")
def missing_processes(spark, folder):
    """Processes without a match at 0.865."""
    processes = view(spark, folder, "processes")
    matched = mt.match_processes(processes, view(spark, folder, "components"), SRC, TGT, 0.865).select(F.col("source_id").alias("process_id"))
    return gp.missing(processes.filter(F.col("system") == SRC), matched, "process_id")


@query("missing_workflows", views=("scripts",), oracle="""
WITH n AS (SELECT system, regexp_replace(lower(name), '[-_ ]', '', 'g') AS k FROM scripts)
SELECT concat('workflow_missing_', k) AS gap_id, 'missing_workflow' AS gap_type, 'high' AS severity, k FROM (SELECT k FROM n WHERE system = 'hadoop' EXCEPT SELECT k FROM n WHERE system = 'abinitio') d
""")
def missing_workflows(spark, folder):
    names = view(spark, folder, "scripts").select("system", tx.normal_name("name").alias("k"))
    return gp.missing_workflows(names.filter("system = 'hadoop'"), names.filter("system = 'abinitio'"), "k")


def _ids(pairs):
    return pairs.select(F.col("source_process").alias("source_id"), F.col("target_process").alias("target_id"))


@query("missing_tables", views=("processes", "components"), oracle=f"""
WITH {PROCESS_PAIRS}, i AS (SELECT DISTINCT process_id AS id, unnest([input_dataset, output_dataset]) AS item FROM components),
lost AS (SELECT source_process, target_process, item FROM pairs JOIN i ON id = source_process
  EXCEPT SELECT source_process, target_process, item FROM pairs JOIN i ON id = target_process)
SELECT left(md5(concat('data_', source_process, '_', target_process)), 16) AS gap_id, 'data_coverage' AS gap_type, 'high' AS severity, source_process AS source_id, target_process AS target_id, item
FROM lost
""")
def missing_tables(spark, folder):
    items = view(spark, folder, "components").select(
        F.col("process_id").alias("id"), F.explode(F.array("input_dataset", "output_dataset")).alias("item"))
    return gp.missing_items(_ids(process_pairs(spark, folder)), items, items, "data_coverage")


@query("missing_columns", views=("processes", "component_schemas"), oracle=f"""
WITH {PROCESS_PAIRS}, {OUT}, i AS (SELECT DISTINCT process_id AS id, lower(target_column) AS item FROM o)
SELECT left(md5(concat('col_', source_process, '_', target_process)), 16) AS gap_id, 'missing_columns' AS gap_type, 'medium' AS severity, source_process AS source_id, target_process AS target_id, item
FROM pairs JOIN i ON id = source_process WHERE NOT EXISTS (SELECT 1 FROM i t WHERE t.id = target_process AND t.item = i.item)
""")
def missing_columns(spark, folder):
    fields_ = components(spark, folder).select(F.col("process_id").alias("id"), F.explode("out_fields").alias("f"))
    items = cut_lineage(fields_.select("id", F.col("f.name").alias("item")).distinct())
    return gp.missing_items(_ids(process_pairs(spark, folder)), items, items, "missing_columns")


@query("missing_component_columns", views=("processes", "component_schemas"), oracle=f"""
WITH {EQUIVALENT}, {OUT}, i AS (SELECT DISTINCT component_id AS id, lower(target_column) AS item FROM o)
SELECT left(md5(concat('col_', source_component, '_', target_component)), 16) AS gap_id, 'missing_columns' AS gap_type, 'medium' AS severity, source_component, target_component, item
FROM equivalent JOIN i ON id = source_component WHERE target_component IN (SELECT id FROM i) AND NOT EXISTS (SELECT 1 FROM i t WHERE t.id = target_component AND t.item = i.item)
""")
def missing_component_columns(spark, folder):
    """Columns compared between each component and its equivalent."""
    fields_ = components(spark, folder).select("component_id", F.explode("out_fields").alias("f")).select("component_id", F.col("f.name").alias("field"))
    return gp.missing_component_columns(equivalent_component(spark, folder), fields_)


@query("count_mismatch", views=("processes", "components"), oracle=f"""
WITH {PROCESS_PAIRS}, c AS (SELECT process_id, count(*) AS n FROM components GROUP BY 1)
SELECT left(md5(concat('logic_', source_process, '_', target_process)), 16) AS gap_id, 'logic_difference' AS gap_type, 'high' AS severity, source_process AS source_id, target_process AS target_id,
 coalesce(a.n, 0) AS source_count, coalesce(b.n, 0) AS target_count FROM pairs LEFT JOIN c a ON a.process_id = source_process LEFT JOIN c b ON b.process_id = target_process WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
""")
def count_mismatch(spark, folder):
    comps = view(spark, folder, "components").select(F.col("process_id").alias("id"))
    return gp.count_mismatch(_ids(process_pairs(spark, folder)), comps, comps)


_TEXTS = """
SELECT source AS id, concat(text, CASE doc_id % 3 WHEN 0 THEN ' Patient Account' WHEN 1 THEN ' person id' ELSE '' END) AS text, lang FROM documents"""


@query("level_mismatch", oracle=f"""
WITH d AS ({_TEXTS}), f AS (SELECT id, lang, bool_or(contains(lower(text), 'patient')) AND bool_or(contains(lower(text), 'account')) AS acct, bool_or(contains(lower(text), 'person')) AS person FROM d GROUP BY id, lang),
g AS (SELECT concat(id, '/', lang) AS id, acct, person FROM f)
SELECT left(md5(concat('agg_', a.id, '_', b.id)), 16) AS gap_id, 'aggregation_level' AS gap_type, 'high' AS severity, a.id AS source_id, b.id AS target_id
FROM g a JOIN g b ON split_part(a.id, '/', 1) = split_part(b.id, '/', 1) AND a.id < b.id WHERE a.acct AND b.person AND NOT b.acct
""")
def level_mismatch(spark, folder):
    """Texts grouped by source and language; groups of the same source are the pairs."""
    table(spark, folder, "documents").createOrReplaceTempView("documents")
    texts = spark.sql(_TEXTS).select(F.concat_ws("/", "id", "lang").alias("id"), "text")
    ids = texts.select("id").distinct().withColumn("k", F.split("id", "/").getItem(0))
    pairs = ids.select(F.col("id").alias("source_id"), "k").join(ids.select(F.col("id").alias("target_id"), "k"), "k") \
        .filter("source_id < target_id").drop("k")
    return gp.level_mismatch(pairs, texts, texts)


@query("gap_summary", views=("gaps",), oracle="""
SELECT gap_type, severity, count(*) AS gaps FROM gaps GROUP BY GROUPING SETS ((gap_type), (severity), ())
""")
def gap_summary(spark, folder):
    return gp.gap_summary(view(spark, folder, "gaps"))


@query("critical_gaps", views=("gaps",), oracle="SELECT * FROM gaps WHERE severity = 'critical'")
def critical_gaps(spark, folder):
    return gp.critical_gaps(view(spark, folder, "gaps"))


@query("gaps_by_severity", views=("gaps",), oracle="""
SELECT gap_type, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM gaps GROUP BY gap_type
""")
def gaps_by_severity(spark, folder):
    return gp.gaps_by_severity(view(spark, folder, "gaps"))


_STATS = f"""{STEPS}, stats AS (SELECT (SELECT count(*) FROM scripts WHERE system = 'hadoop') AS source_scripts, (SELECT count(*) FROM scripts WHERE system = 'databricks') AS target_scripts,
 (SELECT count(DISTINCT name) FROM scripts WHERE system = 'hadoop') AS source_workflows, (SELECT count(DISTINCT name) FROM scripts WHERE system = 'databricks') AS target_workflows,
 (SELECT count(*) FROM steps WHERE system = 'hadoop') AS source_steps, (SELECT count(*) FROM steps WHERE system = 'databricks') AS target_steps,
 (SELECT count(*) FROM gaps WHERE severity = 'critical') AS critical_gaps, (SELECT count(*) FROM gaps WHERE severity = 'high') AS high_gaps, (SELECT count(*) FROM gaps WHERE severity = 'medium') AS medium_gaps,
 (SELECT count(*) FROM gaps WHERE severity = 'low') AS low_gaps, (SELECT count(*) FROM gaps) AS total_gaps)"""


def _stats(spark, folder):
    return gp.comparison_stats(view(spark, folder, "scripts"), steps(spark, folder), view(spark, folder, "gaps"), SRC, TGT)


@query("comparison_stats", views=("scripts", "gaps"), oracle=f"WITH {_STATS} SELECT * FROM stats")
def comparison_stats(spark, folder):
    return _stats(spark, folder)


@query("migration_complexity", views=("scripts", "gaps"), oracle=f"""
WITH {_STATS} SELECT total_gaps, CASE WHEN critical_gaps > 5 OR total_gaps > 50 THEN 'very_high' WHEN critical_gaps > 0 OR high_gaps > 10 THEN 'high' WHEN high_gaps > 0 OR total_gaps > 10 THEN 'medium' ELSE 'low' END AS complexity FROM stats
""")
def migration_complexity(spark, folder):
    return gp.assess_complexity(_stats(spark, folder)).select("total_gaps", "complexity")


@query("gap_recommendations", views=("gaps",), oracle="""
SELECT 'address_critical' AS code, count(*) AS n FROM gaps WHERE severity = 'critical' HAVING count(*) > 0 UNION ALL SELECT 'fix_high', count(*) FROM gaps WHERE severity = 'high' HAVING count(*) > 0
""")
def gap_recommendations(spark, folder):
    return gp.gap_recommendations(view(spark, folder, "gaps"))


@query("order_gaps", views=("gaps",), oracle="""
SELECT *, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank FROM gaps
""")
def order_gaps(spark, folder):
    return order_by_severity(view(spark, folder, "gaps")).orderBy("severity_rank", "gap_id")


# --- sizing ------------------------------------------------------------------------

_EFFORT = """
e AS (SELECT *, CASE WHEN scripts <= 2 THEN 'Small' WHEN scripts <= 6 THEN 'Medium' ELSE 'Big Pipeline' END AS size_class,
  2 + actions * 0.2::DOUBLE AS discovery_hours, scripts * 0.5::DOUBLE * (1 + CAST(loc AS DOUBLE) / 1000) AS code_reading_hours, scripts * (1 + tables * 0.1::DOUBLE) AS mapping_hours, 1 + scripts * 0.3::DOUBLE AS validation_hours FROM measured),
d AS (SELECT *, round_even((discovery_hours + code_reading_hours + mapping_hours + 1 + validation_hours + 2) * CASE size_class WHEN 'Small' THEN 1.0::DOUBLE WHEN 'Medium' THEN 1.1::DOUBLE ELSE 1.3::DOUBLE END / 8 * 2, 0) / 2 AS effort_days FROM e)"""


@query("estimate_effort", views=("measured",), oracle=f"""
WITH {_EFFORT} SELECT flow_id, module, scripts, loc, actions, tables, missing, size_class, effort_days, effort_days * 8 AS effort_hours,
 CASE WHEN effort_days < 1 THEN concat(CAST(CAST(effort_days * 8 AS BIGINT) AS VARCHAR), ' hours') ELSE concat(CASE WHEN effort_days % 1 = 0 THEN CAST(CAST(effort_days AS BIGINT) AS VARCHAR) ELSE printf('%.1f', effort_days) END,
  CASE WHEN effort_days < 2 THEN ' day (' ELSE ' days (' END, CAST(CAST(effort_days * 8 AS BIGINT) AS VARCHAR), ' hours)') END AS effort_text FROM d
""")
def estimate_effort(spark, folder):
    return sz.estimate_effort(view(spark, folder, "measured")).drop(
        "discovery_hours", "code_reading_hours", "mapping_hours", "documentation_hours", "validation_hours", "comparison_hours")


@query("portfolio_summary", views=("measured",), oracle=f"""
WITH {_EFFORT} SELECT size_class, count(*) AS flows, CAST(sum(scripts) AS BIGINT) AS scripts, CAST(sum(missing) AS BIGINT) AS missing, round(sum(effort_days), 6) AS effort_days, round(sum(effort_days * 8), 6) AS effort_hours
FROM d GROUP BY ROLLUP (size_class)
""")
def portfolio_summary(spark, folder):
    return sz.portfolio_summary(sz.estimate_effort(view(spark, folder, "measured")))


_REFS = "SELECT file_id, regexp_extract(unnest(regexp_extract_all(content, '<script>([^<]+)</script>', 1)), '([^/]*)$', 1) AS name FROM files WHERE path LIKE '%.xml'"
_INV = "SELECT regexp_extract(path, '([^/]*)$', 1) AS name, path FROM files WHERE path NOT LIKE '%.xml'"


def _refs_and_inventory(spark, folder):
    files = view(spark, folder, "files").select("file_id", "path", "content")
    xml = tx.extension("path") == ".xml"
    refs = files.filter(xml).select("file_id", F.explode(tx.find_all("content", r"<script>([^<]+)</script>")).alias("ref"))
    return refs.select("file_id", tx.file_name("ref").alias("name")), files.filter(~xml).select(tx.file_name("path").alias("name"), "path")


@query("match_scripts", views=("files",), oracle=f"""
WITH r AS ({_REFS}), i AS ({_INV}), f AS (SELECT name, min(path) AS path FROM i GROUP BY name)
SELECT file_id, name, path, CASE WHEN path IS NULL THEN 'missing' ELSE 'found' END AS status FROM r LEFT JOIN f USING (name)
""")
def match_scripts(spark, folder):
    return sz.match_scripts(*_refs_and_inventory(spark, folder))


@query("used_scripts", views=("files",), oracle=f"""
WITH r AS ({_REFS}), i AS ({_INV}) SELECT name, path, name IN (SELECT name FROM r) AS used FROM i
""")
def used_scripts(spark, folder):
    refs, inventory = _refs_and_inventory(spark, folder)
    return sz.used_scripts(inventory, refs)


# --- roll-ups ------------------------------------------------------------------------

@query("repository_rollup", views=("components",), oracle="""
SELECT system, component_type, count(*) AS components, count(DISTINCT process_id) AS processes, count(DISTINCT input_dataset) AS sources, count(DISTINCT output_dataset) AS targets FROM components GROUP BY ROLLUP (system, component_type)
""")
def repository_rollup(spark, folder):
    return ru.repository_rollup(view(spark, folder, "components"))


@query("repository_datasets", views=("components",), oracle="""
SELECT DISTINCT system, 'source' AS direction, input_dataset AS dataset FROM components UNION ALL SELECT DISTINCT system, 'target', output_dataset FROM components
""")
def repository_datasets(spark, folder):
    return ru.repository_datasets(view(spark, folder, "components"))


@query("repository_domains", views=("processes",), oracle="""
SELECT DISTINCT system, CASE k WHEN 'cdd' THEN 'CDD (Coverage Data Discovery)' WHEN 'gmrn' THEN 'GMRN' WHEN 'lead' THEN 'Lead Generation' ELSE 'Patient Matching' END AS domain
FROM processes, (SELECT unnest(['cdd', 'gmrn', 'lead', 'patient']) AS k) w WHERE contains(lower(business_function), k)
""")
def repository_domains(spark, folder):
    return ru.repository_domains(view(spark, folder, "processes"), name="business_function")


@query("project_summary", views=("processes", "components"), oracle="""
SELECT split_part(path, '/', 3) AS project, count(DISTINCT process_id) AS graphs, count(*) AS components, CAST(sum(length(component_type)) AS BIGINT) AS parameters, count(*) FILTER (input_dataset <> output_dataset) AS flows
FROM components JOIN processes USING (process_id) GROUP BY ROLLUP (split_part(path, '/', 3))
""")
def project_summary(spark, folder):
    p = view(spark, folder, "processes").select("process_id", F.split("path", "/").getItem(2).alias("project"))
    c = view(spark, folder, "components").join(p, "process_id").select(
        "project", F.col("process_id").alias("graph"), F.length("component_type").alias("parameters"),
        (F.col("input_dataset") != F.col("output_dataset")).cast("int").alias("flows"))
    return ru.project_summary(c)


def _notebooks(spark, folder):
    files = view(spark, folder, "files").filter(tx.extension("path") == ".py")
    return files.select("file_id", path_group("path", "first_two").alias("path_group"),
                        F.array_distinct(tx.find_all("content", r"""dbutils\.widgets\.\w+\s*\(\s*["']([^"']+)["']""")).alias("parameters"),
                        tx.find_all("content", r"(?m)^(?:import|from)\s+(\S+)").alias("imports"))


_NB = """nb AS (SELECT file_id, concat(split_part(path, '/', 2), '/', split_part(path, '/', 3)) AS path_group, len(list_distinct(regexp_extract_all(content, 'dbutils\\.widgets\\.\\w+\\s*\\(\\s*["'']([^"'']+)["'']', 1))) AS n_params,
 len(regexp_extract_all(content, '(?m)^(?:import|from)\\s+(\\S+)', 1)) AS n_imports FROM files WHERE path LIKE '%.py')"""


@query("notebook_summary", views=("files",), oracle=f"""
WITH {_NB} SELECT path_group, count(*) AS notebooks, CAST(sum(n_params) AS BIGINT) AS parameters, CAST(sum(n_imports) AS BIGINT) AS dependencies FROM nb GROUP BY path_group
""")
def notebook_summary(spark, folder):
    return ru.notebook_summary(_notebooks(spark, folder))


@query("execution_order", views=("files",), oracle=f"""
WITH {_NB} SELECT file_id, path_group, n_imports, row_number() OVER (PARTITION BY path_group ORDER BY n_imports, file_id) AS execution_order FROM nb
""")
def execution_order(spark, folder):
    return ru.execution_order(_notebooks(spark, folder).drop("parameters"), ["path_group"], "file_id")


@query("collection_stats", oracle="SELECT source, count(*) AS documents FROM documents GROUP BY source")
def collection_stats(spark, folder):
    return ru.collection_stats(table(spark, folder, "documents"))


_ACTIONS = "SELECT l_suppkey AS wf, concat('a', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20)), '_', CAST(l_partkey AS VARCHAR(20)), '_', l_returnflag, l_linestatus) AS action, l_orderkey, l_linenumber, concat(l_returnflag, l_linestatus) AS kind FROM lineitem"


def _actions(spark, folder):
    table(spark, folder, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_ACTIONS)


@query("ordered_actions", oracle=f"""
WITH a AS ({_ACTIONS}) SELECT wf, action, row_number() OVER (PARTITION BY wf ORDER BY l_orderkey, l_linenumber, action) AS position FROM a
""")
def ordered_actions(spark, folder):
    return ru.ordered_actions(_actions(spark, folder), "wf", ["l_orderkey", "l_linenumber", "action"]).select("wf", "action", "position")


@query("sequence_edges", oracle=f"""
WITH a AS ({_ACTIONS}), n AS (SELECT wf, action, row_number() OVER (PARTITION BY wf ORDER BY l_orderkey, l_linenumber, action) AS position,
  lead(action) OVER (PARTITION BY wf ORDER BY l_orderkey, l_linenumber, action) AS to_action, count(*) OVER (PARTITION BY wf) AS last FROM a)
SELECT wf, action AS from_action, to_action, position, position = 1 AS from_entry, position + 1 = last AS to_exit FROM n WHERE to_action IS NOT NULL
""")
def sequence_edges(spark, folder):
    return ru.sequence_edges(_actions(spark, folder), "wf", "action", ["l_orderkey", "l_linenumber", "action"])


@query("flow_text", oracle=f"""
WITH a AS ({_ACTIONS}), n AS (SELECT *, row_number() OVER (PARTITION BY wf ORDER BY l_orderkey, l_linenumber, action) AS no, count(*) OVER (PARTITION BY wf) AS actions FROM a)
SELECT wf, actions, concat(string_agg(concat('[', CAST(no AS VARCHAR), '] ', action, ' (', kind, ')'), concat(chr(10), '    ↓', chr(10)) ORDER BY no),
  CASE WHEN actions > 10 THEN concat(chr(10), '    ... and ', CAST(actions - 10 AS VARCHAR), ' more actions') ELSE '' END) AS flow_text FROM n WHERE no <= 10 GROUP BY wf, actions
""")
def flow_text(spark, folder):
    return ru.flow_text(_actions(spark, folder), "wf", "action", "kind", ["l_orderkey", "l_linenumber", "action"], 10)


@query("diagram_text", views=("edges",), oracle="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS no FROM edges)
SELECT src, concat('graph TD', chr(10), string_agg(concat('    ', src, ' --> ', dst), chr(10) ORDER BY no)) AS diagram FROM n WHERE no <= 20 GROUP BY src
""")
def diagram_text(spark, folder):
    edges = view(spark, folder, "edges").select(F.col("src").alias("wf"), "src", "dst")
    return ru.diagram_text(edges, "wf", "src", "dst", ["dst"], 20).withColumnRenamed("wf", "src")


@query("sample_every", views=("scripts",), oracle="""
SELECT script_id, array_to_string(list_filter(string_split(content, ' '), lambda x, i: i % 2 = 1)[1:5], '|') AS sampled FROM scripts
""")
def sample_every(spark, folder):
    return view(spark, folder, "scripts").select("script_id", ru.sample_every(F.split("content", " "), 2, 5).alias("sampled"))


# --- scalar functions ------------------------------------------------------------------

_CASES = lambda expr, table_, default: f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{default}' END"


@query("type_maps", views=("graph_components",), oracle=f"""
SELECT component_id, {_CASES('component_type', vocab.GRAPH_TO_COMPONENT, 'Unknown')} AS component, {_CASES('component_type', vocab.GRAPH_TO_ACTION, 'script')} AS action,
 {_CASES("lower(split_part(name, '_', 1))", vocab.GRAPH_DATATYPES, 'unknown')} AS graph_type, {HIVE.format("CASE component_id % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'string' WHEN 2 THEN 'char' ELSE 'Map' END")} AS hive_type,
 {_CASES("CASE component_id % 3 WHEN 0 THEN 'spark' WHEN 1 THEN 'java' ELSE 'fs' END", vocab.ACTION_TO_COMPONENT, 'Unknown')} AS action_component FROM graph_components
""")
def type_maps(spark, folder):
    k = F.col("component_id")
    raw = F.when(k % 4 == 0, "BIGINT").when(k % 4 == 1, "string").when(k % 4 == 2, "char").otherwise("Map")
    act = F.when(k % 3 == 0, "SPARK").when(k % 3 == 1, "java").otherwise("fs")
    return view(spark, folder, "graph_components").select(
        "component_id", tx.graph_component_type("component_type").alias("component"), tx.graph_action_type("component_type").alias("action"),
        tx.graph_datatype(F.split("name", "_").getItem(0)).alias("graph_type"), tx.hive_datatype(raw).alias("hive_type"),
        tx.action_component_type(act).alias("action_component"))


@query("normal_transformation", oracle="""
SELECT p_partkey, CASE WHEN contains(x, 'filter') OR contains(x, 'where') THEN 'filter' WHEN contains(x, 'join') THEN 'join' WHEN contains(x, 'group') OR contains(x, 'agg') THEN 'group'
 WHEN contains(x, 'distinct') OR contains(x, 'duplicate') OR contains(x, 'dedup') THEN 'distinct' WHEN contains(x, 'sort') OR contains(x, 'order') THEN 'sort' WHEN contains(x, 'union') THEN 'union' ELSE x END AS kind
FROM (SELECT p_partkey, lower(concat(CASE p_partkey % 7 WHEN 0 THEN 'WHERE ' WHEN 1 THEN 'Left Join ' WHEN 2 THEN 'aggregate ' WHEN 3 THEN 'dedup ' WHEN 4 THEN 'ORDER ' WHEN 5 THEN 'union_all ' ELSE '' END, p_type)) AS x FROM part) t
""")
def normal_transformation(spark, folder):
    k = F.col("p_partkey") % 7
    pre = F.when(k == 0, "WHERE ").when(k == 1, "Left Join ").when(k == 2, "aggregate ").when(k == 3, "dedup ").when(k == 4, "ORDER ").when(k == 5, "union_all ").otherwise("")
    return table(spark, folder, "part").select("p_partkey", tx.normal_transformation(F.concat(pre, "p_type")).alias("kind"))


@query("code_size", oracle="""
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS loc, md5(text) AS content_hash FROM documents
""")
def code_size(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.line_count("text").alias("loc"), F.md5("text").alias("content_hash"))


@query("transformation_rule", oracle="""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN CASE l_returnflag WHEN 'R' THEN 'Direct mapping' ELSE l_returnflag END
  ELSE concat('cast: ', l_linestatus, CASE WHEN l_linenumber % 3 = 2 THEN '; plain' ELSE '' END) END AS rule FROM lineitem
""")
def transformation_rule(spark, folder):
    rule = lambda kind, expr, text_: F.struct(F.lit(kind).alias("rule_type"), expr.alias("expression"), F.lit(text_).alias("description"))
    a, b = rule("cast", F.col("l_linestatus"), "x"), rule("note", F.lit(""), "plain")
    n = F.col("l_linenumber") % 3
    rules = F.when(n == 1, F.array(a)).when(n == 2, F.array(a, b)).otherwise(F.filter(F.array(a), lambda r: F.lit(False)))
    summary = F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", tx.transformation_rule(rules, summary).alias("rule"))


@query("workflow_names", views=("workflows",), oracle="""
WITH w AS (SELECT wf_id, path, regexp_replace(replace(replace(regexp_extract(content, ' name="([^"]*)"', 1), ':', ''), 'wf_1', ''), '^[\\s:_-]+|[\\s:_-]+$', '', 'g') AS n, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem FROM workflows)
SELECT wf_id, CASE WHEN n <> '' THEN n WHEN stem = 'workflow' AND split_part(path, '/', 4) <> 'oozie' THEN split_part(path, '/', 4) ELSE stem END AS name FROM w
""")
def workflow_names(spark, folder):
    w = view(spark, folder, "workflows")
    return w.select("wf_id", tx.workflow_name(F.regexp_extract("content", ' name="([^"]*)"', 1), "path", strip_prefix="wf_1").alias("name"))
