"""Registered queries for lineage graphs, job files, workflow XML, notebooks and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage
from estatelens.functions.text import extension
from estatelens.operators import graphs as gr
from estatelens.operators import jobs as jb
from estatelens.operators import lineage as ln
from estatelens.operators import matching as mt
from estatelens.operators import notebooks as nb
from estatelens.operators import oozie as oz
from estatelens.operators.scripts import script_locations
from estatelens.plans.extraction_queries import _CLASS, LOCATIONS_SQL
from estatelens.plans.registry import lit, lit_list, query
from estatelens.plans.views import table, texts, view

# --- lineage -------------------------------------------------------------------------

_EDGES_SQL = f"""
cls AS ({_CLASS}), loc AS ({LOCATIONS_SQL}),
ge AS (SELECT DISTINCT CASE direction WHEN 'read' THEN concat(location_type, ':', location) ELSE concat('script:f', CAST(file_id AS VARCHAR)) END AS source_id,
  CASE direction WHEN 'read' THEN concat('script:f', CAST(file_id AS VARCHAR)) ELSE concat(location_type, ':', location) END AS target_id,
  CASE direction WHEN 'read' THEN 'reads' ELSE 'writes' END AS edge_type FROM loc)"""


def _graph(spark, folder):
    files = view(spark, folder, "files").select("file_id", "path", "content")
    return ln.lineage_graph(script_locations(files).withColumn("script", F.concat(F.lit("f"), F.col("file_id").cast("string"))))


@query("lineage_graph", views=("files",), oracle=f"WITH {_EDGES_SQL} SELECT * FROM ge")
def lineage_graph(spark, folder):
    return _graph(spark, folder)


@query("graph_nodes", views=("files",), oracle=f"""
WITH {_EDGES_SQL} SELECT DISTINCT node_id, CASE WHEN starts_with(node_id, 'script:') THEN 'script' ELSE 'data_location' END AS node_type, substr(node_id, strpos(node_id, ':') + 1) AS name
FROM (SELECT source_id AS node_id FROM ge UNION ALL SELECT target_id FROM ge) n
""")
def graph_nodes(spark, folder):
    return ln.graph_nodes(_graph(spark, folder))


@query("dedup_edges", oracle="""
SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR)) AS source_id, o_orderpriority AS target_id, o_orderstatus AS edge_type FROM orders
""")
def dedup_edges(spark, folder):
    o = table(spark, folder, "orders")
    return ln.dedup_edges(o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"),
                                   F.col("o_orderpriority").alias("target_id"), F.col("o_orderstatus").alias("edge_type")))


def _walk(a, b, start):
    return f"""
WITH RECURSIVE r AS (SELECT '{start}' AS node, 0 AS depth UNION SELECT e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.node WHERE r.depth < 10)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node <> '{start}' GROUP BY node"""


@query("reach_downstream", views=("edges",), oracle=_walk("src", "dst", "t5"))
def reach_downstream(spark, folder):
    starts = spark.range(1).select(F.lit("t5").alias("node"))
    return ln.reach(view(spark, folder, "edges"), starts, "downstream", 10)


@query("reach_upstream", views=("edges",), oracle=_walk("dst", "src", "t90"))
def reach_upstream(spark, folder):
    starts = spark.range(1).select(F.lit("t90").alias("node"))
    return ln.reach(view(spark, folder, "edges"), starts, "upstream", 10)


def _flow_steps(spark, folder):
    """Tables read and written per step: customers feed orders, orders feed parts, parts feed suppliers."""
    flow = cut_lineage(view(spark, folder, "flow"))
    step = flow.select(F.concat_ws("->", "src", "dst").alias("script"), "src", "dst")
    return step.select("script", F.col("src").alias("tab")), step.select("script", F.col("dst").alias("tab"))


_STARTS = "SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS tab FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0"


@query("trace_table", views=("flow",), oracle=f"""
WITH st AS ({_STARTS}),
h1 AS (SELECT DISTINCT 1 AS hop, src, dst FROM flow JOIN st ON src = tab),
h2 AS (SELECT DISTINCT 2 AS hop, flow.src, flow.dst FROM flow JOIN h1 ON flow.src = h1.dst),
h3 AS (SELECT DISTINCT 3 AS hop, flow.src, flow.dst FROM flow JOIN h2 ON flow.src = h2.dst)
SELECT CAST(hop AS BIGINT) AS hop, concat(src, '->', dst) AS script, src AS source_table, dst AS target_table FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) h
""")
def trace_table(spark, folder):
    """Hops from all customers of one segment with a negative balance."""
    start = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal < 0") \
        .select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tab"))
    return ln.trace_table(*_flow_steps(spark, folder), start, 10)


@query("trace_edges", views=("flow",), oracle=f"""
WITH st AS ({_STARTS}),
h1 AS (SELECT DISTINCT 1 AS hop, src, dst FROM flow JOIN st ON src = tab),
h2 AS (SELECT DISTINCT 2 AS hop, flow.src, flow.dst FROM flow JOIN h1 ON flow.src = h1.dst),
h3 AS (SELECT DISTINCT 3 AS hop, flow.src, flow.dst FROM flow JOIN h2 ON flow.src = h2.dst),
s AS (SELECT src, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) h GROUP BY src)
SELECT DISTINCT CAST(hop AS BIGINT) AS hop, concat('of ', src) AS script, d.direction, CASE d.direction WHEN 'read' THEN src ELSE dst END AS tab
FROM s JOIN flow USING (src), (SELECT unnest(['read', 'write']) AS direction) d
""")
def trace_edges(spark, folder):
    """The same hops where one script reads a node and writes all its successors: one row per table, not per pair."""
    flow = view(spark, folder, "flow").select(F.concat(F.lit("of "), F.col("src")).alias("script"), "src", "dst")
    start = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal < 0") \
        .select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tab"))
    flow = cut_lineage(flow)
    return ln.trace_edges(flow.select("script", F.col("src").alias("tab")), flow.select("script", F.col("dst").alias("tab")), start)


_COLS = """cl AS (
  SELECT concat('f', CAST(l_orderkey % 50 AS VARCHAR)) AS script, concat('t', CAST(l_partkey % 200 AS VARCHAR)) AS source_table, concat('k', CAST(l_linenumber % 3 AS VARCHAR)) AS source_column,
    concat('t', CAST(l_partkey % 200 + 1 + l_suppkey % 20 AS VARCHAR)) AS target_table, concat('k', CAST(l_linenumber % 2 AS VARCHAR)) AS target_column FROM lineitem)"""


def _column_steps(spark, folder):
    s = lambda c: c.cast("string")
    l = table(spark, folder, "lineitem")
    return l.select(
        F.concat(F.lit("f"), s(F.col("l_orderkey") % 50)).alias("script"), F.concat(F.lit("t"), s(F.col("l_partkey") % 200)).alias("source_table"),
        F.concat(F.lit("k"), s(F.col("l_linenumber") % 3)).alias("source_column"),
        F.concat(F.lit("t"), s(F.col("l_partkey") % 200 + 1 + F.col("l_suppkey") % 20)).alias("target_table"),
        F.concat(F.lit("k"), s(F.col("l_linenumber") % 2)).alias("target_column"))


@query("trace_column", oracle=f"""
WITH RECURSIVE {_COLS}, d AS (SELECT DISTINCT * FROM cl),
r AS (SELECT 't3' AS tab, 'k1' AS col, 1 AS hop UNION SELECT target_table, target_column, hop + 1 FROM r JOIN d ON source_table = tab AND source_column = col WHERE hop < 5),
m AS (SELECT tab, col, min(hop) AS hop FROM r GROUP BY 1, 2)
SELECT d.*, CAST(hop AS BIGINT) AS hop FROM d JOIN m ON source_table = tab AND source_column = col
""")
def trace_column(spark, folder):
    start = spark.range(1).select(F.lit("t3").alias("tab"), F.lit("k1").alias("col"))
    return ln.trace_column(_column_steps(spark, folder), start, 5)


@query("hop_graph", oracle=f"""
WITH {_COLS} SELECT DISTINCT concat(source_table, '_', source_column) AS from_node, concat(target_table, '_', target_column) AS to_node, script FROM cl
""")
def hop_graph(spark, folder):
    return ln.hop_graph(_column_steps(spark, folder))


@query("topo_layers", views=("flow",), oracle="""
WITH n AS (SELECT src AS node FROM flow UNION SELECT dst FROM flow),
p AS (SELECT DISTINCT dst FROM flow), l0 AS (SELECT node FROM n WHERE node NOT IN (SELECT dst FROM p)),
o AS (SELECT node, CASE WHEN node IN (SELECT node FROM l0) THEN 0 ELSE 1 END AS layer FROM n WHERE starts_with(node, 'c') OR starts_with(node, 'o')),
pl AS (SELECT dst AS node, max(o.layer) + 1 AS layer FROM flow JOIN o ON o.node = flow.src WHERE starts_with(dst, 'p') GROUP BY dst),
sl AS (SELECT dst AS node, max(pl.layer) + 1 AS layer FROM flow JOIN pl ON pl.node = flow.src GROUP BY dst)
SELECT node, CAST(layer AS BIGINT) AS layer FROM o UNION ALL SELECT node, CAST(layer AS BIGINT) FROM pl UNION ALL SELECT node, CAST(layer AS BIGINT) FROM sl
""")
def topo_layers(spark, folder):
    return ln.topo_layers(view(spark, folder, "flow"))


@query("graph_endpoints", views=("flow",), oracle="""
SELECT DISTINCT src AS node, 'entry' AS endpoint FROM flow WHERE src NOT IN (SELECT dst FROM flow) UNION ALL SELECT DISTINCT dst, 'exit' FROM flow WHERE dst NOT IN (SELECT src FROM flow)
""")
def graph_endpoints(spark, folder):
    return ln.graph_endpoints(view(spark, folder, "flow"))


@query("critical_nodes", views=("edges",), oracle="""
SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT DISTINCT dst FROM edges WHERE dst NOT IN (SELECT src FROM edges)
""")
def critical_nodes(spark, folder):
    return ln.critical_nodes(view(spark, folder, "edges"))


@query("neighbors", views=("edges",), oracle="""
WITH n AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT DISTINCT dst FROM edges WHERE dst NOT IN (SELECT src FROM edges))
SELECT node, 'downstream' AS direction, dst AS neighbor FROM edges JOIN n ON src = node UNION ALL SELECT node, 'upstream', src FROM edges JOIN n ON dst = node
""")
def neighbors(spark, folder):
    """Neighbours of the entry and exit nodes."""
    edges = view(spark, folder, "edges")
    return ln.neighbors(edges, ln.critical_nodes(edges))


@query("nested_io", oracle="""
WITH RECURSIVE up AS (SELECT p_partkey AS wf, p_partkey AS anc FROM part UNION SELECT wf, CAST((anc - anc % 10) / 10 AS BIGINT) FROM up WHERE anc > 0)
SELECT DISTINCT concat('w', CAST(anc AS VARCHAR)) AS workflow, CASE p_partkey % 2 WHEN 0 THEN 'input' ELSE 'output' END AS direction, concat('d', CAST(p_size AS VARCHAR)) AS dataset FROM up JOIN part ON p_partkey = wf
""")
def nested_io(spark, folder):
    """Workflow k is nested in workflow k / 10; datasets move up to every ancestor."""
    k = F.col("p_partkey")
    wf = lambda c: F.concat(F.lit("w"), c.cast("bigint").cast("string"))
    p = table(spark, folder, "part")
    parents = p.filter(k > 0).select(wf((k - k % 10) / 10).alias("parent"), wf(k).alias("child"))
    io = p.select(wf(k).alias("workflow"), F.when(k % 2 == 0, "input").otherwise("output").alias("direction"),
                  F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("dataset"))
    return ln.nested_io(parents, io)


# --- job files ---------------------------------------------------------------------------

_KEYS = lit_list(vocab.JIL_KEYWORDS)


@query("sniff_format", views=("job_files",), oracle=f"""
SELECT file_id, hits FROM (SELECT file_id, len(list_filter({_KEYS}, lambda k: contains(lower(array_to_string(string_split(content, chr(10))[1:20], chr(10))), k))) AS hits FROM job_files) z WHERE hits >= 2
""")
def sniff_format(spark, folder):
    return jb.sniff_format(view(spark, folder, "job_files")).select("file_id", "hits")


@query("sniff_documents", oracle=f"""
SELECT doc_id, len(list_filter(['der', 'the', 'que', 'les'], lambda k: contains(lower(array_to_string(string_split(text, chr(10))[1:20], chr(10))), k))) AS hits FROM documents
WHERE len(list_filter(['der', 'the', 'que', 'les'], lambda k: contains(lower(array_to_string(string_split(text, chr(10))[1:20], chr(10))), k))) >= 2
""")
def sniff_documents(spark, folder):
    docs = texts(spark, folder).select("doc_id", F.col("text").alias("content"))
    return jb.sniff_format(docs, ["der", "the", "que", "les"]).select("doc_id", "hits")


@query("job_files", views=("job_files",), oracle="SELECT file_id, path FROM job_files WHERE path LIKE '%.jil' OR contains(content, 'insert_job:')")
def job_files(spark, folder):
    return jb.job_files(view(spark, folder, "job_files")).select("file_id", "path")


def _jobs(spark, folder):
    return jb.jil_jobs(jb.job_files(view(spark, folder, "job_files")).select("file_id", "content"))


def _stored_jobs(spark, folder):
    """Parsed jobs, written once for plans that read them several times."""
    return cut_lineage(_jobs(spark, folder).select("job_name", "command", "condition"))


_JOBS = """jobs AS (
  SELECT file_id, concat('load_', CAST(file_id AS VARCHAR)) AS job_name, regexp_extract(content, 'command: (.+)', 1) AS command, regexp_extract(content, 'machine: (.+)', 1) AS machine,
    regexp_extract(content, 'condition: (.+)', 1) AS condition, replace(regexp_extract(content, 'description: (.+)', 1), '"', '') AS description FROM job_files WHERE contains(content, 'insert_job:')
  UNION ALL SELECT file_id, concat('check_', CAST(file_id AS VARCHAR)), regexp_extract(content, '(?s)update_job:.*command: ([^' || chr(10) || ']+)', 1), NULL, regexp_extract(content, '(?s)update_job:.*condition: ([^' || chr(10) || ']+)', 1), NULL FROM job_files WHERE contains(content, 'update_job:'))"""


@query("jil_jobs", views=("job_files",), oracle=f"WITH {_JOBS} SELECT file_id, job_name, 'CMD' AS job_type, command, machine, condition, description FROM jobs")
def jil_jobs(spark, folder):
    return _jobs(spark, folder).select("file_id", "job_name", "job_type", "command", "machine", "condition", "description")


@query("job_dependencies", views=("job_files",), oracle=f"""
WITH {_JOBS}, c AS (SELECT job_name, condition, unnest(regexp_extract_all(condition, '(?i)\\b([sfdrntp])\\(([^)]+)\\)', 0)) AS m FROM jobs),
l AS (SELECT job_name, condition, unnest(regexp_extract_all(condition, '(?i)\\b(success|done|failure|running|terminated|notrunning)\\(([^)]+)\\)', 0)) AS m FROM jobs WHERE NOT regexp_matches(condition, '(?i)\\b[sfdrntp]\\('))
SELECT regexp_extract(m, '\\((.+)\\)', 1) AS source_job, job_name AS target_job, CASE left(m, 1) WHEN 's' THEN 'success' WHEN 'd' THEN 'done' END AS condition_type, condition AS condition_full FROM c
UNION ALL SELECT regexp_extract(m, '\\((.+)\\)', 1), job_name, split_part(m, '(', 1), condition FROM l
""")
def job_dependencies(spark, folder):
    return jb.job_dependencies(_jobs(spark, folder))


_GRAPH = "CASE WHEN starts_with(job_name, 'check_') THEN NULL ELSE CASE file_id % 6 WHEN 0 THEN concat('gr_', CAST(file_id AS VARCHAR)) WHEN 1 THEN concat('/opt/psets/gr_', CAST(file_id AS VARCHAR)) WHEN 2 THEN concat('gr_', CAST(file_id AS VARCHAR), '.mp') WHEN 3 THEN concat('sand/gr_', CAST(file_id AS VARCHAR)) ELSE concat('gr_', CAST(file_id AS VARCHAR)) END END"


@query("graph_from_command", views=("job_files",), oracle=f"WITH {_JOBS} SELECT job_name, {_GRAPH} AS graph FROM jobs")
def graph_from_command(spark, folder):
    return jb.job_graphs(_jobs(spark, folder)).select("job_name", "graph")


# graph names known to the estate: one per third job
_KNOWN = "SELECT concat('gr_', CAST(p_partkey AS VARCHAR)) AS name FROM part WHERE p_size % 3 = 0"


def _known(spark, folder):
    return table(spark, folder, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("gr_"), F.col("p_partkey").cast("string")).alias("name"))


@query("jobs_to_graphs", views=("job_files",), oracle=f"""
WITH {_JOBS}, g AS (SELECT job_name, {_GRAPH} AS ref FROM jobs), k AS ({_KNOWN})
SELECT job_name, min(name) AS graph FROM g JOIN k ON contains(ref, name) OR contains(name, ref) GROUP BY job_name
""")
def jobs_to_graphs(spark, folder):
    return _job_map(spark, folder)


def _job_map(spark, folder):
    return _map_of(jb.job_graphs(_jobs(spark, folder)), spark, folder)


def _map_of(jobs, spark, folder):
    refs = cut_lineage(jobs.filter("graph IS NOT NULL").select("job_name", F.col("graph").alias("ref")))
    return refs.join(mt.containing_names(refs, _known(spark, folder)), "ref").select("job_name", F.col("name").alias("graph"))


@query("lift_edges", views=("job_files",), oracle=f"""
WITH {_JOBS}, g AS (SELECT job_name, {_GRAPH} AS ref FROM jobs), k AS ({_KNOWN}),
m AS (SELECT job_name, min(name) AS graph FROM g JOIN k ON contains(ref, name) OR contains(name, ref) GROUP BY job_name),
d AS (SELECT unnest(regexp_extract_all(condition, '\\b[sd]\\(([^)]+)\\)', 1)) AS src, job_name AS dst FROM jobs)
SELECT src, dst, a.graph AS source_graph, b.graph AS target_graph FROM d JOIN m a ON a.job_name = src JOIN m b ON b.job_name = dst
""")
def lift_edges(spark, folder):
    jobs = _stored_jobs(spark, folder)
    deps = jb.job_dependencies(jobs).select(F.col("source_job").alias("src"), F.col("target_job").alias("dst"))
    return ln.lift_edges(deps, _map_of(jb.job_graphs(jobs), spark, folder).withColumnRenamed("job_name", "job"))


@query("job_flow", views=("job_files",), oracle=f"""
WITH {_JOBS}, d AS (SELECT unnest(regexp_extract_all(condition, '\\b[a-z]+\\(([^)]+)\\)', 1)) AS src, job_name AS dst FROM jobs),
s AS (SELECT unnest(regexp_extract_all(condition, '\\b[sd]\\(([^)]+)\\)', 1)) AS src, job_name AS dst FROM jobs UNION ALL SELECT unnest(regexp_extract_all(condition, '\\b(?:success|terminated)\\(([^)]+)\\)', 1)), job_name FROM jobs WHERE starts_with(job_name, 'check_'))
SELECT (SELECT count(*) FROM jobs WHERE job_name NOT IN (SELECT dst FROM s)) AS entry_jobs, (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM jobs WHERE starts_with(job_name, 'load_')) AS graph_jobs, (SELECT count(*) FROM s) AS total_dependencies
""")
def job_flow(spark, folder):
    jobs = _stored_jobs(spark, folder)
    deps = jb.job_dependencies(jobs).select(F.col("source_job").alias("src"), F.col("target_job").alias("dst"))
    return ln.job_flow(jb.job_graphs(jobs).select(F.col("job_name").alias("job"), "graph"), deps)


# --- workflow XML --------------------------------------------------------------------------

@query("select_workflow_files", views=("workflows",), oracle="""
SELECT wf_id, path FROM workflows WHERE regexp_matches(path, '(/|_)(workflow|coordinator)\\.xml$') OR list_contains(string_split(path, '/'), 'oozie') OR list_contains(string_split(path, '/'), 'coordinators')
""")
def select_workflow_files(spark, folder):
    return oz.select_workflow_files(view(spark, folder, "workflows")).select("wf_id", "path")


@query("detect_workflows", views=("workflows",), oracle="""
WITH w AS (SELECT path, contains(content, '<workflow-app') AS wf, regexp_extract(content, '-app name="([^"]*)"', 1) AS name FROM workflows WHERE NOT contains(path, 'target'))
SELECT 'workflow' AS kind, name, min(path) AS path FROM w WHERE wf GROUP BY name UNION ALL SELECT 'coordinator', '', path FROM w WHERE NOT wf
""")
def detect_workflows(spark, folder):
    return oz.detect_workflows(view(spark, folder, "workflows"))


_ACT = """a AS (SELECT wf_id, regexp_extract(content, 'frequency="([^"]*)"', 1) AS f, unnest(regexp_extract_all(content, '(?s)<action.*?</action>', 0)) AS x FROM workflows),
b AS (SELECT wf_id, x, CASE WHEN contains(x, '<workflow>') THEN 'coordinator_trigger' ELSE regexp_extract(x, '<action name="([^"]*)"', 1) END AS action, f, CASE WHEN contains(x, '<workflow>') THEN 'coordinator' ELSE regexp_extract(x, '<action[^>]*><([a-z-]+)', 1) END AS action_type FROM a)"""


@query("oozie_actions", views=("workflows",), oracle=f"""
WITH {_ACT} SELECT wf_id, action, action_type, CASE action_type WHEN 'spark' THEN regexp_extract(x, '<jar>([^<]*)', 1) WHEN 'shell' THEN regexp_extract(x, '<exec>([^<]*)', 1) ELSE regexp_extract(x, '<script>([^<]*)', 1) END AS script,
  CASE action_type WHEN 'coordinator' THEN concat('frequency=', f, '|referenced_workflow=', regexp_extract(x, '<app-path>([^<]*)', 1)) WHEN 'spark' THEN concat('master=', regexp_extract(x, '<master>([^<]*)', 1), '|main_class=', regexp_extract(x, '<class>([^<]*)', 1)) ELSE array_to_string(regexp_extract_all(x, '<param>([^<]*)', 1), '|') END AS parameters,
  CASE action_type WHEN 'spark' THEN array_to_string(list_filter(regexp_extract_all(x, '<arg>([^<]*)', 1), lambda v: regexp_matches(lower(v), 'table|input|source')), '|')
    WHEN 'shell' THEN array_to_string(list_filter(regexp_extract_all(x, '<argument>([^<]*)', 1), lambda v: regexp_matches(lower(v), 'table|input|source')), '|')
    WHEN 'pig' THEN regexp_extract(x, '<param>INPUT_TABLE=([^<]*)', 1)
    WHEN 'hive' THEN concat_ws('|', regexp_extract(x, 'FROM (\\w+)', 1), regexp_extract(x, 'JOIN (\\w+)', 1), regexp_extract(x, 'INTO TABLE (\\w+)', 1), 'TABLE') WHEN 'sqoop' THEN regexp_extract(x, '--table (\\w+)', 1) ELSE '' END AS inputs,
  CASE action_type WHEN 'spark' THEN array_to_string(list_filter(regexp_extract_all(x, '<arg>([^<]*)', 1), lambda v: starts_with(v, 'output')), '|')
    WHEN 'shell' THEN array_to_string(list_filter(regexp_extract_all(x, '<argument>([^<]*)', 1), lambda v: starts_with(v, 'target')), '|')
    WHEN 'pig' THEN regexp_extract(x, '<param>outputDir=([^<]*)', 1) WHEN 'sqoop' THEN regexp_extract(x, '--target-dir (\\S+?)<', 1) ELSE '' END AS outputs
FROM b
""")
def oozie_actions(spark, folder):
    return oz.oozie_actions(view(spark, folder, "workflows").select("wf_id", "content"))


@query("oozie_actions_resolved", views=("workflows",), oracle=f"""
WITH {_ACT} SELECT wf_id, action, action_type, CASE action_type
    WHEN 'spark' THEN array_to_string(list_filter(regexp_extract_all(x, '<arg>([^<]*)', 1), lambda v: starts_with(v, 'output')), '|')
    WHEN 'shell' THEN array_to_string(list_filter(regexp_extract_all(x, '<argument>([^<]*)', 1), lambda v: starts_with(v, 'target')), '|')
    WHEN 'pig' THEN replace(regexp_extract(x, '<param>outputDir=([^<]*)', 1), 'hdfs://nn', concat('hdfs://n', CAST(wf_id % 5 AS VARCHAR), ':8020'))
    WHEN 'sqoop' THEN concat('/in/', CAST(wf_id AS VARCHAR), regexp_extract(x, '--target-dir /land(\\S+?)<', 1), '/', chr(36), '{{day}}/<wf:id()>') ELSE '' END AS outputs
FROM b
""")
def oozie_actions_resolved(spark, folder):
    """Outputs of actions named through variables, with each workflow's own property file; `day` is in no file."""
    flows = view(spark, folder, "workflows").select("wf_id", "content")
    text = F.replace(F.replace("content", F.lit("hdfs://nn/"), F.lit("${nameNode}/")), F.lit("--target-dir /land"), F.lit("--target-dir ${land}"))
    text = F.replace(text, F.lit("</command>"), F.lit("/${day}/${wf:id()}</command>"))
    own = F.concat(F.lit("# of this workflow\nnameNode = hdfs://n"), (F.col("wf_id") % 5).cast("string"), F.lit(":8020\nland=/old\nland=/in/"), F.col("wf_id").cast("string"))
    known = oz.property_map(oz.read_properties(flows.select("wf_id", own.alias("content"))), "wf_id")
    return oz.resolve_actions(oz.oozie_actions(flows.withColumn("content", text)), known, "wf_id").select("wf_id", "action", "action_type", "outputs")


_PROPS = """pr AS (SELECT wf_id, regexp_extract(content, '<app-path>([^<]*)</app-path><configuration>', 1) AS app_path, unnest(regexp_extract_all(regexp_extract(content, '(?s)<configuration>.*?</configuration>', 0), '<property>.*?</property>', 0)) AS p FROM workflows WHERE contains(content, '<configuration>')),
kv AS (SELECT wf_id, app_path, regexp_extract(p, '<name>([^<]*)', 1) AS key, regexp_extract(p, '<value>([^<]*)', 1) AS value FROM pr)"""


@query("subworkflow_io", views=("workflows",), oracle=f"""
WITH {_PROPS} SELECT wf_id, app_path, key, value, CASE WHEN regexp_matches(lower(key), 'input|source') THEN 'input' WHEN regexp_matches(lower(key), 'output|target') THEN 'output' ELSE 'input' END AS direction
FROM kv WHERE key IN {tuple(vocab.SUBWORKFLOW_KEYS)} AND NOT starts_with(value, '$')
""")
def subworkflow_io(spark, folder):
    return oz.subworkflow_io(oz.subworkflow_properties(view(spark, folder, "workflows").select("wf_id", "content")))


@query("resolve_variables", views=("workflows",), oracle=f"""
WITH {_PROPS} SELECT wf_id, key, replace(replace(value, concat(chr(36), '{{tgt}}'), concat('out_of_', CAST(wf_id AS VARCHAR))), concat(chr(36), '{{nameNode}}'), 'x') AS value,
  replace(app_path, concat(chr(36), '{{nameNode}}'), concat(chr(36), '{{nameNode}}')) AS app_path FROM kv
""")
def resolve_variables(spark, folder):
    """Values use the properties of their own workflow; paths use a name nobody defines."""
    rows = oz.subworkflow_properties(view(spark, folder, "workflows").select("wf_id", "content"))
    own = F.create_map(F.lit("tgt"), F.concat(F.lit("out_of_"), F.col("wf_id").cast("string")))
    rows = oz.resolve_variables(rows.withColumn("props", own), "value", "props")
    return oz.resolve_variables(rows, "app_path", "props").select("wf_id", "key", "value", "app_path")


@query("workflow_facts", views=("workflows",), oracle="""
SELECT wf_id, len(regexp_extract_all(content, '<action[ >]', 0)) AS actions, CASE WHEN contains(content, '<coordinator-app') THEN '' ELSE
   array_to_string(list_sort(list_filter([regexp_extract(content, '<script>sql/([^<]*)', 1), regexp_extract(content, 'lib/([^<]*)', 1), regexp_extract(content, '<script>pig/([^<]*)', 1), regexp_extract(content, '<exec>([^<]*)', 1)], lambda x: x <> '')), '|') END AS scripts,
  CASE WHEN contains(content, '<coordinator-app') THEN '' ELSE array_to_string(list_sort([regexp_extract(content, 'hdfs://nn/data/([^<]*)', 1), regexp_extract(content, '<name>table</name><value>([^<]*)', 1)]), '|') END AS tables
FROM workflows
""")
def workflow_facts(spark, folder):
    return oz.workflow_facts(view(spark, folder, "workflows").select("wf_id", "content"))


_PROPERTY_TEXT = "SELECT o_orderkey, concat('# order', chr(10), 'status = ', o_orderstatus, chr(10), 'note=a=', o_orderpriority, chr(10), 'plain', chr(10), 'cust=', CAST(o_custkey AS VARCHAR(20))) AS content FROM orders"


@query("read_properties", oracle="""
SELECT o_orderkey, k AS entry_no, CASE k WHEN 1 THEN 'status' WHEN 2 THEN 'note' ELSE 'cust' END AS key, CASE k WHEN 1 THEN o_orderstatus WHEN 2 THEN concat('a=', o_orderpriority) ELSE CAST(o_custkey AS VARCHAR) END AS value
FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS k) ks
""")
def read_properties(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return oz.read_properties(spark.sql(_PROPERTY_TEXT))


# --- notebooks ----------------------------------------------------------------------------

@query("explode_cells", views=("notebooks",), oracle="""
WITH c AS (SELECT nb_id, path, unnest(regexp_extract_all(content, '\\{"cell_type": "(?:markdown|code)", "source": \\[.*?\\]\\}', 0)) AS x, generate_subscripts(regexp_extract_all(content, '\\{"cell_type": "(?:markdown|code)", "source": \\[.*?\\]\\}', 0), 1) - 1 AS cell_no FROM notebooks)
SELECT nb_id, path, cell_no, regexp_extract(x, '"cell_type": "(\\w+)"', 1) AS cell_type, replace(regexp_extract(x, '"source": \\["(.*)"\\]', 1), '", "', '') AS source FROM c
""")
def explode_cells(spark, folder):
    return nb.explode_cells(view(spark, folder, "notebooks"))


@query("cell_transformations", views=("notebooks",), oracle="""
WITH c AS (SELECT nb_id, path, unnest(regexp_extract_all(content, '\\{"cell_type": "code", "source": \\[.*?\\]\\}', 0)) AS x, generate_subscripts(regexp_extract_all(content, '\\{"cell_type": "code", "source": \\[.*?\\]\\}', 0), 1) AS cell_no FROM notebooks),
s AS (SELECT nb_id, path, cell_no, replace(regexp_extract(x, '"source": \\["(.*)"\\]', 1), '", "', '') AS snippet FROM c)
SELECT *, 'sql' AS kind FROM s WHERE starts_with(snippet, '%sql') UNION ALL SELECT *, 'filter' FROM s WHERE contains(snippet, 'filter(') OR contains(snippet, 'where(')
UNION ALL SELECT *, 'join' FROM s WHERE contains(snippet, 'join(') UNION ALL SELECT *, 'group' FROM s WHERE contains(snippet, 'groupBy(') OR contains(snippet, 'agg(')
""")
def cell_transformations(spark, folder):
    return nb.cell_transformations(view(spark, folder, "notebooks"), 200)


_PY = "(SELECT file_id, content FROM files WHERE path LIKE '%.py')"
_nbf = lambda p, g=1: f"unnest(regexp_extract_all(content, {lit(p)}, {g}))"


@query("notebook_facts", views=("files",), oracle=f"""
WITH py AS {_PY}
SELECT DISTINCT file_id, kind, value FROM (
  SELECT file_id, 'parameter' AS kind, {_nbf(nb.WIDGET)} AS value FROM py UNION ALL SELECT file_id, 'run', trim({_nbf(nb.RUN)}) FROM py
  UNION ALL SELECT file_id, 'module', split_part({_nbf('(?m)^(?:from|import) ([^ ,' + chr(10) + ']+)')}, '.', 1) FROM py
  {' '.join(f"UNION ALL SELECT file_id, 'input_table', {_nbf(p)} FROM py" for p in nb.INPUT_TABLES)}
  {' '.join(f"UNION ALL SELECT file_id, 'output_table', {_nbf(p)} FROM py" for p in nb.OUTPUT_TABLES)}
  {' '.join(f"UNION ALL SELECT file_id, 'input_path', {_nbf(p)} FROM py" for p in nb.READ_PATHS)}
  {' '.join(f"UNION ALL SELECT file_id, 'output_path', {_nbf(p)} FROM py" for p in nb.WRITE_PATHS)}
  UNION ALL SELECT file_id, 'operation', op FROM py, (SELECT unnest({lit_list(vocab.NOTEBOOK_OPERATIONS)}) AS op) o WHERE regexp_matches(content, concat('\\.', op, '\\s*\\('))
  UNION ALL SELECT file_id, 'schema_field', {_nbf(nb.STRUCT_FIELD)} FROM py WHERE contains(content, 'StructType([')) f WHERE value <> ''
""")
def notebook_facts(spark, folder):
    files = view(spark, folder, "files").filter(extension("path") == ".py").select("file_id", "content")
    return nb.notebook_facts(files)


@query("embedded_sql", views=("files",), oracle=f"""
WITH py AS {_PY} SELECT file_id, {_nbf(nb.SQL_CALL)} AS sql_text FROM py UNION ALL SELECT file_id, {_nbf(nb.SQL_MAGIC)} FROM py
""")
def embedded_sql(spark, folder):
    return nb.embedded_sql(view(spark, folder, "files").filter(extension("path") == ".py").select("file_id", "content"))


# --- graph blocks --------------------------------------------------------------------------

@query("block_parameters", views=("blocks",), oracle="""
WITH p AS (SELECT graph, block_no, unnest(regexp_extract_all(block_text, '\\{\\d+\\|XXparameter\\|!?[^|]+\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|[^}]*\\}', 0)) AS x FROM blocks)
SELECT graph, block_no, ltrim(split_part(x, '|', 3), '!') AS name, split_part(x, '|', 4) AS value FROM p WHERE NOT starts_with(split_part(x, '|', 3), '_ab_')
""")
def block_parameters(spark, folder):
    return gr.block_parameters(view(spark, folder, "blocks"))


_COMP = "comp AS (SELECT graph, block_no, split_part(block_text, '|', 2) AS component_type, regexp_extract(block_text, '^\\{(\\d+)', 1) AS component_id, split_part(block_text, '|', 3) AS component_name FROM blocks WHERE regexp_matches(block_text, '\\|(Reformat|Join|Rollup)\\|'))"


@query("block_components", views=("blocks",), oracle=f"WITH {_COMP} SELECT * FROM comp")
def block_components(spark, folder):
    return gr.block_components(view(spark, folder, "blocks"))


@query("block_edges", views=("blocks",), oracle=f"""
WITH {_COMP}, e AS (SELECT graph, unnest(regexp_extract_all(block_text, '\\{{\\d+\\}} -+> \\{{\\d+\\}}', 0)) AS x FROM blocks),
i AS (SELECT graph, regexp_extract(x, '^\\{{(\\d+)', 1) AS source_id, regexp_extract(x, '(\\d+)\\}}$', 1) AS target_id FROM e)
SELECT i.*, coalesce(a.component_name, concat('component_', source_id)) AS source_name, coalesce(b.component_name, concat('component_', target_id)) AS target_name
FROM i LEFT JOIN comp a ON a.graph = i.graph AND a.component_id = source_id LEFT JOIN comp b ON b.graph = i.graph AND b.component_id = target_id
""")
def block_edges(spark, folder):
    return gr.block_edges(view(spark, folder, "blocks"))


def _params(spark, folder):
    """Graph components with their parameter text as a map."""
    c = view(spark, folder, "graph_components")
    pairs = F.transform(F.split("params", ";"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"),
                                                                  F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")))
    return c.withColumn("params", F.map_from_entries(pairs))


_P = "list_filter(string_split(params, ';'), lambda p: starts_with(p, concat({0}, '=')))[1]"


def _val(name):
    return f"substr({_P.format(lit(name))}, {len(name) + 2})"


@query("component_transformations", views=("graph_components",), oracle=f"""
SELECT component_id, name, component_type, 'transform' AS kind, replace(e, '=', ' = ') AS snippet, NULL AS condition FROM (SELECT *, unnest(list_filter(string_split(params, ';'), lambda p: regexp_matches(split_part(p, '=', 1), 'expr|formula'))) AS e FROM graph_components WHERE component_type = 'Reformat') t
UNION ALL SELECT component_id, name, component_type, 'filter', concat('FILTER: ', coalesce({_val('filter_expr')}, {_val('condition')})), coalesce({_val('filter_expr')}, {_val('condition')}) FROM graph_components WHERE component_type = 'Filter'
UNION ALL SELECT component_id, name, component_type, 'join', concat('JOIN ON ', coalesce({_val('join_key')}, {_val('key')}), ' (', coalesce({_val('join_type')}, 'inner'), ')'), concat('key=', coalesce({_val('join_key')}, {_val('key')})) FROM graph_components WHERE component_type = 'Join'
UNION ALL SELECT component_id, name, component_type, 'aggregate', concat('GROUP BY ', coalesce({_val('group_by')}, {_val('key')}), ' AGGREGATE ', coalesce({_val('expression')}, '')), concat('group_by=', coalesce({_val('group_by')}, {_val('key')})) FROM graph_components WHERE component_type = 'Rollup'
UNION ALL SELECT component_id, name, component_type, 'sort', concat('SORT BY ', coalesce({_val('sort_key')}, {_val('key')})), NULL FROM graph_components WHERE component_type = 'Sort'
""")
def component_transformations(spark, folder):
    return gr.component_transformations(_params(spark, folder))


@query("dml_fields", views=("graph_components",), oracle=f"""
WITH t AS (SELECT component_id, name, coalesce({_val('dml')}, dml) AS txt FROM graph_components),
f AS (SELECT component_id, name, unnest(regexp_extract_all(txt, '(\\w+)\\s+\\w+\\([^)]+\\)', 1)) AS fld, generate_subscripts(regexp_extract_all(txt, '(\\w+)\\s+\\w+\\([^)]+\\)', 1), 1) - 1 AS field_no FROM t)
SELECT component_id, field_no, name AS source_table, fld AS source_column, name AS target_table, fld AS target_column FROM f
""")
def dml_fields(spark, folder):
    return gr.dml_fields(_params(spark, folder))


_FILL = """g AS (SELECT *, contains(lower(key), 'graph') AND contains(lower(key), 'name') AS is_graph, contains(lower(key), 'summary') AS is_summary FROM summary_rows),
f AS (SELECT *, last_value(CASE WHEN is_graph THEN value END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no) AS graph FROM g),
o AS (SELECT *, CASE WHEN graph IS NOT NULL AND NOT is_graph AND NOT is_summary THEN CASE WHEN contains(lower(key), 'input') THEN 'inputs' WHEN contains(lower(key), 'output') THEN 'outputs' END END AS opens FROM f),
s AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no) AS section FROM o)"""


@query("parse_summary_rows", views=("summary_rows",), oracle=f"""
WITH {_FILL} SELECT sheet, row_no, graph, section, split_part(value, ' ', 1) AS component_id, split_part(value, ' ', 2) AS component_name,
  trim(string_split(value, '-')[2]) AS file_path, CASE WHEN regexp_matches(value, '^\\d+_[A-Z]+') THEN regexp_extract(value, ' - [^-]* - (.*)$', 1) ELSE coalesce(trim(string_split(value, '-')[3]), '') END AS description
FROM s WHERE graph IS NOT NULL AND NOT is_graph AND NOT is_summary AND opens IS NULL AND section IS NOT NULL AND contains(value, ' - ')
""")
def parse_summary_rows(spark, folder):
    return gr.parse_summary_rows(view(spark, folder, "summary_rows"), span=10_000)


@query("graph_summaries", views=("summary_rows",), oracle=f"""
WITH {_FILL} SELECT sheet, graph, coalesce(max(value) FILTER (is_summary), '') AS summary FROM s WHERE graph IS NOT NULL GROUP BY sheet, graph
""")
def graph_summaries(spark, folder):
    return gr.graph_summaries(view(spark, folder, "summary_rows"))


def _chains(spark, folder):
    """Parts as chains of 30: (j, next one or null)."""
    last = (F.col("j") % 30 == 29) | (F.col("j") == F.col("top"))
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("j"))
    return p.crossJoin(p.agg(F.max("j").alias("top"))).select("j", F.when(~last, F.col("j") + 1).alias("k"))  # one row on the right


def _named(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


@query("topo_deep", oracle="""
SELECT concat('n', CAST(p_partkey AS VARCHAR)) AS node, CAST(p_partkey % 30 AS BIGINT) AS layer FROM part
WHERE p_partkey % 30 <> 0 OR p_partkey < (SELECT max(p_partkey) FROM part)
""")
def topo_deep(spark, folder):
    return ln.topo_layers(_chains(spark, folder).filter("k is not null").select(_named("n", "j").alias("src"), _named("n", "k").alias("dst")))


@query("nested_io_deep", oracle="""
SELECT concat('w', CAST(a.p_partkey AS VARCHAR)) AS workflow, 'input' AS direction, concat('d', CAST(b.p_partkey AS VARCHAR)) AS dataset
FROM part a JOIN part b ON (a.p_partkey) // 30 = (b.p_partkey) // 30 AND b.p_partkey >= a.p_partkey
""")
def nested_io_deep(spark, folder):
    c = _chains(spark, folder)
    parents = c.filter("k is not null").select(_named("w", "j").alias("parent"), _named("w", "k").alias("child"))
    return ln.nested_io(parents, c.select(_named("w", "j").alias("workflow"), F.lit("input").alias("direction"), _named("d", "j").alias("dataset")))


@query("trace_deep", oracle="""
SELECT CAST(p_partkey % 30 + 1 AS BIGINT) AS hop, concat('s', CAST(p_partkey AS VARCHAR)) AS script,
  concat('t', CAST(p_partkey AS VARCHAR)) AS source_table, concat('t', CAST(p_partkey + 1 AS VARCHAR)) AS target_table
FROM part WHERE p_partkey % 30 <> 29 AND p_partkey < (SELECT max(p_partkey) FROM part)
""")
def trace_deep(spark, folder):
    c = _chains(spark, folder).filter("k is not null")
    reads = c.select(_named("s", "j").alias("script"), _named("t", "j").alias("tab"))
    writes = c.select(_named("s", "j").alias("script"), _named("t", "k").alias("tab"))
    return ln.trace_table(reads, writes, c.filter("j % 30 = 0").select(_named("t", "j").alias("tab")))
