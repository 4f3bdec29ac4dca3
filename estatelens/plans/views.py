"""Views derived from the given tables that look like a code estate and grow with them.

The same SQL text runs in Spark and in other SQL engines: only concat, chr, CASE and casts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from estatelens.functions.scale import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SPECIAL = {"\n": 10, "'": 39, "$": 36, "\\": 92}


def text_sql(template: str, **names: str) -> str:
    """SQL expression for a text template; `[[name]]` is replaced by a SQL expression."""
    parts = []
    for piece in re.split(r"(\[\[\w+\]\]|[\n'$\\])", template):
        if not piece:
            continue
        if piece in _SPECIAL:
            parts.append(f"chr({_SPECIAL[piece]})")
        elif piece.startswith("[["):
            parts.append(names[piece[2:-2]])
        else:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts)})"


def s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(20))"


_TGT = f"CASE p_size % 3 WHEN 0 THEN {s('p_partkey - p_partkey % 4')} ELSE concat('x', {s('p_partkey')}) END"
_N = dict(
    k=s("p_partkey"), block=s("p_partkey - p_partkey % 4"), tgt=_TGT, size=s("p_size"),
    dec=s("p_partkey - p_partkey % 10"), m3=s("p_partkey % 3"), m5=s("p_partkey % 5"),
    m7=s("p_partkey % 7"), m11=s("p_partkey % 11"), brand="p_brand", type="p_type",
    name="replace(p_name, ' ', '_')", prev=s("p_partkey - 1"), prev2=s("p_partkey - 2"),
    next=s("p_partkey + 1"), up=s("CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT)"),
)


def _t(template: str) -> str:
    return text_sql(template, **_N)


SCRIPTS = f"""
SELECT p_partkey AS script_id,
  CASE p_partkey % 3 WHEN 0 THEN 'hadoop' WHEN 1 THEN 'databricks' ELSE 'abinitio' END AS system,
  concat(CASE p_partkey % 3 WHEN 0 THEN 'wf_' WHEN 1 THEN 'WF-' ELSE 'wf ' END, {s('p_partkey - p_partkey % 3')}) AS name,
  concat({_t('/repo[[m7]]/app[[m5]]/s[[k]]')}, CASE p_partkey % 3 WHEN 0 THEN '.hql' WHEN 1 THEN '.py' ELSE '.pig' END) AS path,
  concat(CASE WHEN (p_partkey - p_partkey % 4) % 40 <> 0 THEN '' WHEN p_partkey % 3 = 1 THEN '# patient' ELSE '-- patient' END, chr(10),
    CASE p_partkey % 3
      WHEN 0 THEN concat({_t('INSERT OVERWRITE TABLE tgt_[[tgt]] SELECT a.c, SUM(a.v) FROM src_[[block]] a ')},
             CASE p_size % 2 WHEN 0 THEN '' ELSE {_t('LEFT JOIN dim_[[size]] b ON a.k = b.k ')} END, 'WHERE a.v IS NOT NULL GROUP BY a.c;')
      WHEN 1 THEN {_t('''df = spark.read.table("src_[[block]]").filter("v > [[size]]").join(d, "k").groupBy("c").sum("v")
df.write.mode("overwrite").saveAsTable("tgt_[[tgt]]")''')}
      ELSE {_t('''a = LOAD 'src_[[block]]';
b = FILTER a BY v > [[size]];
c = FOREACH b GENERATE a.k AS k, v * 2 AS w;
STORE c INTO 'tgt_[[tgt]]';''')}
    END) AS content
FROM part
"""

COMPONENTS = f"""
SELECT concat('c', {s('l_orderkey')}, '_', {s('l_linenumber')}) AS component_id,
  concat('p', {s('l_suppkey')}) AS process_id,
  CASE l_suppkey % 2 WHEN 0 THEN 'hadoop' ELSE 'databricks' END AS system,
  concat(l_returnflag, l_linestatus) AS component_type,
  concat('ds_', {s('l_partkey % 300')}) AS input_dataset,
  concat('ds_', {s('l_orderkey % 300')}) AS output_dataset
FROM lineitem
"""

PROCESSES = f"""
SELECT concat('p', {s('s_suppkey')}) AS process_id,
  CASE s_suppkey % 2 WHEN 0 THEN 'hadoop' ELSE 'databricks' END AS system,
  lower(concat('proc_', {s('s_suppkey % 40')}, '_', n_name)) AS name,
  n_name AS business_domain,
  concat(CASE s_suppkey % 3 WHEN 0 THEN 'patient ' ELSE '' END, CASE s_suppkey % 5 WHEN 0 THEN 'coverage' WHEN 1 THEN 'lead' ELSE 'other' END) AS business_function,
  concat('/estate/proj', {s('s_nationkey % 4')}, '/', lower(replace(n_name, ' ', '_')), '/p', {s('s_suppkey')}, '.xml') AS path
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

EDGES = f"""
SELECT DISTINCT concat('t', {s('o_custkey % 400')}) AS src, concat('t', {s('o_custkey % 400 + 1 + o_orderkey % 9')}) AS dst FROM orders
"""

# customer -> order -> part -> supplier: four layers, as many nodes as the tables hold.
FLOW = f"""
SELECT DISTINCT src, dst FROM (
  SELECT concat('c', {s('o_custkey')}) AS src, concat('o', {s('o_orderkey')}) AS dst FROM orders
  UNION ALL SELECT concat('o', {s('l_orderkey')}), concat('p', {s('l_partkey')}) FROM lineitem
  UNION ALL SELECT concat('p', {s('l_partkey')}), concat('s', {s('l_suppkey')}) FROM lineitem) all_steps
"""

GAPS = f"""
SELECT md5(concat('gap_', {s('event_id')})) AS gap_id, event_type AS gap_type,
  CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CASE user_id % 2 WHEN 0 THEN 'hadoop' ELSE 'databricks' END AS source_system
FROM events
"""

# One file per part in eight kinds: Hive load, DDL, query, Pig, shell, PySpark, notebook, workflow.
FILES = f"""
SELECT p_partkey AS file_id,
  CASE p_partkey % 3 WHEN 0 THEN 'hadoop' WHEN 1 THEN 'databricks' ELSE 'abinitio' END AS system,
  concat({_t('/repo[[m7]]/')}, CASE p_size % 5 WHEN 0 THEN 'workflows' WHEN 1 THEN 'oozie' WHEN 2 THEN 'mp' WHEN 3 THEN 'dml' ELSE 'build' END,
    {_t('/app[[m5]]/')},
    CASE WHEN p_partkey % 8 = 7 AND p_size % 2 = 0 THEN 'workflow' ELSE {_t('f[[k]]')} END,
    CASE p_partkey % 8 WHEN 0 THEN '.hql' WHEN 1 THEN '.hql' WHEN 2 THEN '.sql' WHEN 3 THEN '.pig'
         WHEN 4 THEN '.sh' WHEN 5 THEN '.py' WHEN 6 THEN '.py' ELSE '.xml' END) AS path,
  CASE p_partkey % 8
    WHEN 0 THEN concat({_t('''-- load of claim rows for [[brand]]
INSERT OVERWRITE TABLE dw.tgt_[[tgt]]
SELECT a.c, SUM(a.v), count (a.k) FROM dw.src_[[block]] a
LEFT OUTER JOIN dim_[[size]] b ON a.k = b.k
WHERE a.v IS NOT NULL AND a.status = 'ACTIVE' AND a.n > [[size]]
GROUP BY a.c, a.d ORDER BY a.c;
''')}, CASE p_size % 2 WHEN 0 THEN '' ELSE {_t('''INSERT INTO audit_[[m5]] SELECT DISTINCT c FROM dw.tgt_[[tgt]] t JOIN src_[[block]] u ON t.k = u.k WHERE length(t.c) > 2;
SELECT MAX(x) FROM (SELECT x FROM audit_[[m5]]) q
UNION SELECT 1;
''')} END)
    WHEN 1 THEN concat({_t('CREATE ')}, CASE p_size % 2 WHEN 0 THEN 'EXTERNAL TABLE' ELSE 'TABLE' END, {_t(''' IF NOT EXISTS ext_[[k]] (id BIGINT, [[name]] STRING, amt DOUBLE, d DATE, ts TIMESTAMP)''')},
         CASE p_size % 2 WHEN 0 THEN {_t(''' LOCATION '/data/ext/[[k]]';''')} ELSE ';' END)
    WHEN 2 THEN {_t('''SELECT DISTINCT t.c FROM tgt_[[tgt]] t INNER JOIN dim_[[size]] ON t.k = dim_[[size]].k
WHERE t.v BETWEEN 1 AND [[size]] ORDER BY t.c;''')}
    WHEN 3 THEN {_t('''SET job.name '[[name]]';
SET default_parallel [[size]];
DEFINE clean com.acme.Clean();
DEFINE hash_it md5_hash;
raw = LOAD '/in/src_[[block]]' USING PigStorage();
cat = LOAD "hcat_[[m11]]" USING x; hc = foo HCatLoader('db.t_[[m5]]');
f = FILTER raw BY age >= 18 AND status == 'ACTIVE' AND x IS NOT NULL;
g = FILTER f BY v > [[size]];
j = JOIN f BY raw::id LEFT OUTER, cat BY id;
k = JOIN g BY id, cat BY cat::cid;
grp = GROUP j BY region, city;
o = FOREACH grp GENERATE grp.region AS region, SUM(j.v) AS total, v * 2 AS dbl, name, max_v;
d = DISTINCT o;
s = ORDER d BY region, total;
u = UNION d, s;
STORE u INTO '/out/tgt_[[tgt]]' USING HCatStorer('db.o_[[k]]');''')}
    WHEN 4 THEN concat({_t('''#!/bin/sh
source env_[[m5]].sh
./run_[[k]].sh
bash load_[[k]].sh; python job_[[m7]].py
pig -f jobs/p_[[k]].pig
hive -f f_[[k]].hql
spark-submit --x app.py "conf_[[m3]].sql" 'other_[[k]].py'
''')}, CASE p_size % 3 WHEN 0 THEN {_t('''echo done >> /logs/run_[[k]].log
echo "again" >>/logs/all.log;
''')} ELSE '' END, CASE p_size % 2 WHEN 0 THEN {_t('''hive -e "SELECT c FROM tgt_[[tgt]] JOIN dim_[[size]]"
''')} ELSE '' END, CASE p_size % 5 WHEN 0 THEN {_t('''hive -e "INSERT INTO x_[[k]] SELECT 1 FROM y_[[k]]"
''')} ELSE '' END)
    WHEN 5 THEN {_t('''df = spark.read.parquet("/mnt/raw/src_[[block]]")
t = spark.table("dw.src_[[block]]")
e = spark.read.csv('dbfs:/in/e_[[m5]].csv')
f = df.where("v > [[size]]").filter(t.status)
j = f.join(t, "k", how="left").join(e, on=key)
a = j.groupBy("c", "d").agg(total)
p = a.select("c", 'total').distinct()
p.write.parquet("/mnt/out/tgt_[[tgt]]")
p.write.saveAsTable("dw.tgt_[[tgt]]")''')}
    WHEN 6 THEN {_t('''# Databricks notebook for eligibility [[brand]]
import os
import pyspark.sql.functions as F
from pyspark.sql.types import StructType
from delta.tables import DeltaTable
%run "./shared/util_[[m3]]"
%run /jobs/common_[[m5]]
dbutils.widgets.text("run_date", "")
dbutils.widgets.dropdown("env_[[m3]]", "dev", ["dev"])
schema = StructType([StructField("id", LongType()), StructField('amt_[[m5]]', DoubleType())])
df = spark.read.csv("/mnt/in/f_[[k]].csv").withColumn("x", F.lit(1)).filter("x > 0")
q = spark.sql("SELECT a FROM dw.src_[[block]] JOIN dw.dim_[[size]] ON 1 = 1")
df.groupBy("a").agg(F.sum("x")).cache().write.parquet("/mnt/out/o_[[k]]")
df.write.mode("append").saveAsTable("dw.tgt_[[tgt]]")
%sql SELECT b FROM dw.tgt_[[tgt]] WHERE b > 1
% end''')}
    ELSE {_t('''<workflow-app name="wf_[[dec]]"><action name="a1"><pig><script>jobs/p_[[k]].pig</script></pig></action>
<action name="a2"><hive><script>f_[[prev]].hql</script></hive></action></workflow-app>''')}
  END AS content
FROM part
"""

# Workflow XML with all action types, properties passed to sub-workflows and hdfs paths.
WORKFLOWS = f"""
SELECT p_partkey AS wf_id,
  concat('/estate/', CASE p_size % 4 WHEN 0 THEN 'oozie' WHEN 1 THEN 'coordinators' WHEN 2 THEN 'misc' ELSE 'target' END, {_t('/wf[[k]]/')},
    CASE p_size % 3 WHEN 0 THEN 'workflow.xml' WHEN 1 THEN {_t('w[[k]]_workflow.xml')} ELSE {_t('w[[k]].xml')} END) AS path,
  CASE WHEN p_partkey % 9 = 8 THEN {_t('''<?xml version="1.0"?>
<coordinator-app name="coord_[[k]]" frequency="[[size]]" start="2024-01-01" end="2025-01-01" xmlns="uri:oozie:coordinator:0.4"><action><workflow><app-path>/apps/wf_[[prev]]</app-path></workflow></action></coordinator-app>''')}
  ELSE concat({_t('''<workflow-app name=": wf_[[dec]]_[[m3]] -" xmlns="uri:oozie:workflow:0.5">
<parameters><property><name>queue</name><value>q[[m5]]</value></property></parameters>
<action name="pig_[[k]]"><pig><script>pig/p_[[k]].pig</script><param>INPUT_TABLE=src_[[block]]</param><param>outputDir=hdfs://nn/data/out_[[k]]</param><param>mode=full</param></pig></action>
<action name="hive_[[k]]"><hive xmlns="uri:oozie:hive-action:0.2"><script>''')}, CASE p_size % 2 WHEN 0 THEN {_t('${appPath}/f.hql')} ELSE {_t('sql/f_[[k]].hql')} END,
      {_t('''</script><query>INSERT INTO TABLE agg_[[k]] SELECT * FROM src_[[block]] JOIN dim_[[size]]</query></hive></action>
<action name="spark_[[k]]"><spark><master>yarn</master><jar>lib/job_[[m7]].jar</jar><class>com.acme.Main</class><arg>--input=src_[[block]]</arg><arg>output_[[k]]</arg><arg>verbose</arg></spark></action>
<action name="shell_[[k]]"><shell><exec>run_[[k]].sh</exec><argument>source_[[m5]]</argument><argument>target_[[k]]</argument></shell></action>
<action name="sqoop_[[k]]"><sqoop><command>import --table ORD_[[k]] --target-dir /land/ord_[[k]]</command></sqoop></action>
<action name="sub_[[k]]"><sub-workflow><app-path>''')}, CASE p_partkey % 2 WHEN 0 THEN '' ELSE '/apps' END,
      {_t('''${nameNode}/wf_[[up]]</app-path><configuration><property><name>table</name><value>shared_[[m7]]</value></property><property><name>inputTable</name><value>in_[[k]]</value></property><property><name>targetTable</name><value>out_[[k]]</value></property><property><name>target</name><value>${tgt}</value></property><property><name>color</name><value>red</value></property></configuration></sub-workflow></action>
</workflow-app>''')}) END AS content
FROM part
"""

JOB_FILES = f"""
SELECT p_partkey AS file_id, concat({_t('/jobs/box[[m7]]/j[[k]]')}, CASE p_size % 2 WHEN 0 THEN '.jil' ELSE '' END) AS path,
  CASE WHEN p_partkey % 6 = 5 THEN {_t('''readme of [[name]]
owner: nobody
''')} ELSE concat({_t('''/* jobs of [[brand]] */
insert_job: load_[[k]]
job_type: CMD
command: ''')}, CASE p_partkey % 6
      WHEN 0 THEN {_t('runpset.ksh -P gr_[[k]].pset -d')}
      WHEN 1 THEN {_t('/opt/psets/gr_[[k]].pset')}
      WHEN 2 THEN {_t('/opt/run gr_[[k]].mp')}
      WHEN 3 THEN {_t('air sandbox run sand/gr_[[k]]')}
      ELSE {_t('run.sh graph=gr_[[k]] x')} END, {_t('''
machine: host[[m5]]
owner: etl
condition: s(load_[[prev]]) & done(load_[[prev2]])
description: "loads [[type]]"

# comment: skip
update_job: check_[[k]]
job_type: CMD
command: check.sh [[k]]
condition: success(load_[[k]]) | terminated(stop_[[m5]])
''')}) END AS content
FROM part
"""

BLOCKS = f"""
SELECT {_t('g_[[dec]]')} AS graph, p_partkey AS block_no,
  CASE WHEN p_partkey % 10 = 0 THEN {_t('''{30001001|XXgraph|x|XXparameter_set|@@@@{{{1|XXparameter|!RUN_DATE|2024-01-[[m7]]|1|2|3|x}{2|XXparameter|_ab_hidden|9|1|2|3|x}}}@ {[[next]]} --> {[[k]]}''')}
  ELSE concat('{{', {_t('[[k]]|')}, CASE p_size % 4 WHEN 0 THEN 'Reformat' WHEN 1 THEN 'Join' WHEN 2 THEN 'Rollup' ELSE 'Unlisted' END,
    {_t('''|[[name]]_[[k]]|}XXparameter_set|@@@@{{{1|XXparameter|mode|m[[m3]]|1|2|3|x}{2|XXparameter|key|k[[m5]]|1|2|3|x}}}@ {[[k]]} ---> {[[prev]]}''')}) END AS block_text
FROM part
"""

GRAPH_COMPONENTS = f"""
SELECT p_partkey AS component_id, {_t('[[name]]_[[k]]')} AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'Reformat' WHEN 1 THEN 'Filter' WHEN 2 THEN 'Join' WHEN 3 THEN 'Rollup' WHEN 4 THEN 'Sort' ELSE 'Input_File' END AS component_type,
  CASE p_size % 2 WHEN 0 THEN {_t('filter_expr=v > [[size]];join_key=id_[[m3]];group_by=g[[m5]];sort_key=s[[m7]];out_expr=a + [[k]];formula2=b')}
    ELSE {_t('condition=w < [[size]];key=k[[m3]];join_type=left;expression=sum(v);dml=id integer(4) nm string(|)') } END AS params,
  CASE p_size % 3 WHEN 0 THEN {_t('record id integer(4); [[name]] string(20); amt decimal(10,2); end')} ELSE '' END AS dml
FROM part
"""

# Spreadsheet-style rows: a sheet per customer, five rows per order.
SUMMARY_ROWS = f"""
SELECT sheet, row_no, CASE k WHEN 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'Graph Name' ELSE 'note' END
                   WHEN 1 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'Summary' ELSE 'note' END
                   WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'misc' ELSE 'Input Files' END
                   WHEN 3 THEN 'item' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'Output Files' ELSE 'item' END END AS key,
  CASE k WHEN 0 THEN concat('graph_', {s('o_orderkey')})
         WHEN 1 THEN concat('loads orders of ', {s('o_custkey')})
         WHEN 3 THEN concat({s('o_orderkey')}, '_IFIL part', {s('o_custkey')}, ' - /in/', {s('o_custkey')}, '.dat - rows of ', o_orderpriority)
         WHEN 4 THEN concat('x', {s('o_orderkey')}, ' sup', {s('o_custkey')}, ' - /out/', {s('o_orderkey')}, '.dat')
         ELSE '' END AS value
FROM (SELECT o_custkey AS sheet, o_orderkey * 5 + k AS row_no, k, o_orderkey, o_custkey, o_orderpriority
      FROM orders CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) five) cells
"""

NOTEBOOKS = f"""
SELECT p_partkey AS nb_id, {_t('/nb/[[m7]]/n_[[k]].ipynb')} AS path,
  concat({_t('{"cells": [{"cell_type": "markdown", "source": ["# [[name]]"]}, {"cell_type": "code", "source": ["df = spark.read.table(src)", ".filter(x)", ".join(y)"]}, ')},
    CASE p_size % 2 WHEN 0 THEN {_t('{"cell_type": "code", "source": ["%sql SELECT a FROM t_[[k]]"]}, ')} ELSE '' END,
    {_t('{"cell_type": "code", "source": ["out = df.groupBy(k).agg(m_[[m5]])"]}]}')}) AS content
FROM part
"""

ANALYSIS_JSON = f"""
SELECT p_partkey AS doc_id,
  CASE p_partkey % 2 WHEN 0 THEN
    {_t('{"pipelines": {"p_[[m5]]": {"notebooks": [{"name": "nb_claim_[[k]]", "path": "/nb/[[k]]", "input_tables": ["b_[[block]]", "a_[[block]]", "a_[[block]]"], "output_tables": ["o_[[k]]"], "input_paths": [], "output_paths": ["/out/[[k]]"], "key_operations": ["join", "filter", "select"]}, {"name": "two_[[k]]", "path": "/policy/[[k]]", "input_tables": [], "output_tables": [], "input_paths": ["/i/[[m3]]"], "output_paths": [], "key_operations": ["groupBy"]}]}}}')}
  ELSE
    {_t('{"graphs": {"gr_lead_[[k]]": {"summary": "member load [[brand]]", "inputs": [{"file_path": "/in/[[block]]"}, {"file_path": ""}], "outputs": [{"file_path": "/out/[[k]]"}], "transformations": ["sort", "join"]}}}')}
  END AS content
FROM part
"""

ITEM_JSON = """
SELECT event_id, CASE event_id % 2 WHEN 0 THEN
    concat('[{"id": "e', CAST(event_id AS VARCHAR(20)), '", "type": "', event_type, '", "name": "u', CAST(user_id AS VARCHAR(20)), '"}, {"name": "plain"}]')
  ELSE concat('{"', event_type, '": [{"id": "k', CAST(event_id AS VARCHAR(20)), '", "v": 1}, {"v": 2}], "meta": 5}') END AS content
FROM events
"""

QUESTIONS = """
SELECT conv_id, turn, concat(CASE (conv_id + turn) % 12
    WHEN 0 THEN 'Compare the hadop pig job with the databricks notebook load_claims '
    WHEN 1 THEN 'trace column member_id upstream '
    WHEN 2 THEN 'generate report for the flow '
    WHEN 3 THEN 'what replaced workflow wf_12 '
    WHEN 4 THEN 'explain how it works '
    WHEN 5 THEN 'list all graph names that use table "claims" '
    WHEN 6 THEN 'is the join rule a check in Abinito '
    WHEN 7 THEN 'ab initio graph X versus spark '
    WHEN 8 THEN 'which column is calculated upstream '
    WHEN 9 THEN 'are both workflow copies equivalent '
    WHEN 10 THEN 'Databrick job calls '
    ELSE '' END, text) AS question
FROM conversations
"""

# Components with input and output fields written as `name:type` lists.
COMPONENT_SCHEMAS = f"""
SELECT concat('c', {s('l_orderkey')}, '_', {s('l_linenumber')}, '_', {s('l_partkey')}, '_', {s('l_suppkey')}) AS component_id,
  concat('p', {s('l_suppkey')}) AS process_id,
  concat(CASE l_linenumber % 2 WHEN 0 THEN 'load_' ELSE 'stage_load_' END, {s('l_partkey % 50')}) AS name,
  CASE l_suppkey % 2 WHEN 0 THEN 'hadoop' ELSE 'databricks' END AS system,
  CASE WHEN l_linenumber % 4 = 3 THEN '' ELSE concat('ID:int,Amt:', CASE l_linenumber % 2 WHEN 0 THEN 'double' ELSE 'float' END, ',q', {s('l_partkey % 5')}, ':string') END AS in_spec,
  CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE concat('id:bigint,amt:double,q', {s('l_suppkey % 5')}, ':string,flag:char') END AS out_spec,
  concat('ds_', {s('l_partkey % 300')}) AS input_dataset,
  concat('ds_', {s('l_orderkey % 300')}) AS output_dataset,
  CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN concat('x = 1', chr(10), '  amt = price * qty', chr(10), 'id = key') ELSE 'plain copy of rows' END AS logic
FROM lineitem
"""

# One measured workflow per order: scripts, lines of code, actions, tables.
MEASURED = """
SELECT o_orderkey AS flow_id, concat('m', CAST(o_custkey % 20 AS VARCHAR(20))) AS module,
  o_custkey % 9 AS scripts, o_orderkey % 3000 AS loc, o_orderkey % 12 AS actions, o_custkey % 6 AS tables,
  o_custkey % 3 AS missing
FROM orders
"""

VIEWS = {
    "scripts": SCRIPTS, "components": COMPONENTS, "processes": PROCESSES, "edges": EDGES,
    "flow": FLOW, "gaps": GAPS, "files": FILES, "workflows": WORKFLOWS, "job_files": JOB_FILES,
    "blocks": BLOCKS, "graph_components": GRAPH_COMPONENTS, "summary_rows": SUMMARY_ROWS,
    "notebooks": NOTEBOOKS, "analysis_json": ANALYSIS_JSON, "item_json": ITEM_JSON,
    "questions": QUESTIONS, "component_schemas": COMPONENT_SCHEMAS, "measured": MEASURED,
}
USES = {
    "scripts": ["part"], "components": ["lineitem"], "processes": ["supplier", "nation"],
    "edges": ["orders"], "flow": ["orders", "lineitem"], "gaps": ["events"], "files": ["part"],
    "workflows": ["part"], "job_files": ["part"], "blocks": ["part"], "graph_components": ["part"],
    "summary_rows": ["orders"], "notebooks": ["part"], "analysis_json": ["part"],
    "item_json": ["events"], "questions": ["conversations"], "component_schemas": ["lineitem"],
    "measured": ["orders"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LIGHT = {"edges", "flow", "gaps", "processes", "components", "measured"}  # little work per row


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of texts, spread over the cores before the work on them."""
    return spread(table(spark, folder, name))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view over the tables of one folder."""
    for used in USES[name]:
        df = table(spark, folder, used)
        (df if name in LIGHT else spread(df)).createOrReplaceTempView(used)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """Prefix a SELECT with the named views as common table expressions."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
