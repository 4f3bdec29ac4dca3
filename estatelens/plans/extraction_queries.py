"""Registered queries for extraction from script text."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.text import contained_words, extension, file_name, find_all, file_stem
from estatelens.operators import pig_scripts as pig
from estatelens.operators import scripts as sc
from estatelens.operators import spark_scripts as spk
from estatelens.operators import sql_scripts as sql
from estatelens.plans.registry import lit, lit_list, query
from estatelens.plans.views import texts, view


def files(spark, folder, *exts, columns=("file_id", "content")):
    """Files of some extensions; the filter runs before any regex touches the text."""
    df = view(spark, folder, "files")
    if exts:
        df = df.filter(extension("path").isin(*exts))
    return df.select(*columns)


SQL_FILES = "SELECT file_id, content FROM files WHERE path LIKE '%.hql' OR path LIKE '%.sql'"
PIG_FILES = "SELECT file_id, content FROM files WHERE path LIKE '%.pig'"
PY_FILES = "SELECT file_id, content FROM files WHERE path LIKE '%.py'"


def unnest_kinds(source: str, key: str, kinds: list[tuple[str, str]], value="value") -> str:
    return " UNION ".join(f"SELECT {key}, {lit(k)} AS kind, unnest({e}) AS {value} FROM ({source}) src" for k, e in kinds)


def find(pattern: str, group: int = 1, text: str = "content") -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


@query("sql_table_refs", views=("files",), oracle=f"""
SELECT file_id, kind, value FROM (
  SELECT file_id, 'read' AS kind, unnest({find(sql.FROM_TABLE)}) AS value, true AS from_rule FROM ({SQL_FILES}) a
  UNION ALL SELECT file_id, 'read', unnest({find(sql.JOIN_TABLE)}), false FROM ({SQL_FILES}) b
  UNION ALL SELECT file_id, 'write', unnest({find(sql.INSERT_TABLE)}), false FROM ({SQL_FILES}) c
  UNION ALL SELECT file_id, 'write', unnest({find(sql.CREATE_TABLE)}), false FROM ({SQL_FILES}) d) hits
WHERE NOT (from_rule AND upper(value) IN ('SELECT', 'WHERE', 'GROUP')) GROUP BY file_id, kind, value
""")
def sql_table_refs(spark, folder):
    return sql.sql_table_refs(files(spark, folder, ".hql", ".sql"))


@query("sql_transformations", views=("files",), oracle=f"""
WITH f AS ({SQL_FILES}), steps AS (
  SELECT file_id, 1 AS grp, m.i AS i, 'filter' AS kind, m.x AS x FROM f, LATERAL (SELECT unnest({find(sql.WHERE_CLAUSE, 1, 'f.content')}) AS x, generate_subscripts({find(sql.WHERE_CLAUSE, 1, 'f.content')}, 1) AS i) m
  UNION ALL SELECT file_id, 2, m.i, 'join', m.x FROM f, LATERAL (SELECT unnest({find(sql.JOIN_CLAUSE, 0, 'f.content')}) AS x, generate_subscripts({find(sql.JOIN_CLAUSE, 0, 'f.content')}, 1) AS i) m
  UNION ALL SELECT file_id, 3, m.i, 'group_by', m.x FROM f, LATERAL (SELECT unnest({find(sql.GROUP_CLAUSE, 1, 'f.content')}) AS x, generate_subscripts({find(sql.GROUP_CLAUSE, 1, 'f.content')}, 1) AS i) m
  UNION ALL SELECT file_id, 4, m.i, 'aggregate', m.x FROM f, LATERAL (SELECT unnest({find(sql.AGGREGATE_CALL, 1, 'f.content')}) AS x, generate_subscripts({find(sql.AGGREGATE_CALL, 1, 'f.content')}, 1) AS i) m)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY grp, i) AS step_no, kind,
  CASE kind WHEN 'filter' THEN concat('WHERE ', trim(x, concat(' ', chr(10)))) WHEN 'join' THEN left(x, 200)
    WHEN 'group_by' THEN concat('GROUP BY ', trim(x, concat(' ', chr(10)))) ELSE concat(upper(x), '(...)') END AS snippet,
  CASE kind WHEN 'filter' THEN trim(x, concat(' ', chr(10)))
    WHEN 'join' THEN trim(regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 3), concat(' ', chr(10))) END AS condition,
  CASE kind WHEN 'join' THEN upper(trim(regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 1), concat(' ', chr(10)))) END AS join_type,
  CASE kind WHEN 'join' THEN regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 2) END AS table_name,
  CASE kind WHEN 'group_by' THEN array_to_string(list_transform(string_split(trim(x, concat(' ', chr(10))), ','), lambda v: trim(v)), '|') ELSE '' END AS columns,
  CASE kind WHEN 'aggregate' THEN upper(x) END AS function_name
FROM steps
""")
def sql_transformations(spark, folder):
    return sql.sql_transformations(files(spark, folder, ".hql", ".sql"), 200)


@query("pig_io", views=("files",), oracle=unnest_kinds(PIG_FILES, "file_id", [
    ("read_file", find(pig.LOAD)), ("write_file", find(pig.STORE)),
    ("read_table", find(pig.HCAT_LOAD)), ("write_table", find(pig.HCAT_STORE))]))
def pig_io(spark, folder):
    return pig.pig_io(files(spark, folder, ".pig"))


@query("pig_variables", views=("files",), oracle=f"""
WITH f AS ({PIG_FILES}), m AS (
  SELECT file_id, 0 AS d, unnest(regexp_extract_all(content, {lit(pig.SET)}, 0)) AS x FROM f
  UNION ALL SELECT file_id, 1, unnest(regexp_extract_all(content, {lit(pig.DEFINE)}, 0)) FROM f)
SELECT file_id, CASE d WHEN 0 THEN regexp_extract(x, {lit(pig.SET)}, 1) ELSE concat('DEFINE_', regexp_extract(x, {lit(pig.DEFINE)}, 1)) END AS name,
  CASE d WHEN 0 THEN trim(trim(regexp_extract(x, {lit(pig.SET)}, 2)), '''"') ELSE trim(regexp_extract(x, {lit(pig.DEFINE)}, 2)) END AS value,
  d = 1 AND contains(regexp_extract(x, {lit(pig.DEFINE)}, 2), '(') AS is_function
FROM m
""")
def pig_variables(spark, folder):
    return pig.pig_variables(files(spark, folder, ".pig"))


_PIG_STEPS = " UNION ALL ".join(
    f"SELECT file_id, content, {lit(k)} AS kind, unnest({find(p, 0)}) AS x, generate_subscripts({find(p, 0)}, 1) AS i FROM ({PIG_FILES}) q"
    for k, p in pig.STATEMENTS.items())
_P3 = "CASE kind " + " ".join(
    f"WHEN {lit(k)} THEN trim(regexp_extract(x, {lit(p)}, 3))" for k, p in pig.STATEMENTS.items()
    if k not in ("distinct", "union")) + " ELSE '' END"
_IDENT = f"list_sort(list_distinct(list_filter({find(pig.IDENTIFIER, 1, 'body')}, lambda n: NOT upper(n) IN ('AND','OR','NOT','IS','NULL','TRUE','FALSE','IN','LIKE','BETWEEN'))))"
_HAS_AGG = "(contains(upper({0}), 'SUM') OR contains(upper({0}), 'COUNT') OR contains(upper({0}), 'AVG') OR contains(upper({0}), 'MAX') OR contains(upper({0}), 'MIN'))"


@query("pig_transformations", views=("files",), oracle=f"""
WITH steps AS ({_PIG_STEPS}), b AS (SELECT *, {_P3} AS body FROM steps)
SELECT file_id, CASE WHEN kind <> 'foreach' THEN kind WHEN {_HAS_AGG.format('body')} THEN 'aggregate' ELSE 'transform' END AS step_type,
  concat(kind, '_', CAST(i AS VARCHAR)) AS step_id,
  length(left(content, strpos(content, x) - 1)) - length(replace(left(content, strpos(content, x) - 1), chr(10), '')) + 1 AS line_no,
  x AS snippet, CASE kind WHEN 'filter' THEN body END AS condition,
  CASE WHEN kind = 'join' THEN CASE WHEN contains(upper(x), 'LEFT') THEN 'LEFT OUTER JOIN' WHEN contains(upper(x), 'FULL OUTER') THEN 'FULL OUTER JOIN' ELSE 'INNER JOIN' END END AS join_type,
  CASE WHEN kind IN ('group', 'order') THEN array_to_string(list_transform(string_split(body, ','), lambda v: trim(v)), '|')
    WHEN kind = 'join' THEN array_to_string(list_transform(string_split(body, ','), lambda v: trim(string_split(v, '::')[-1])), '|')
    WHEN kind = 'filter' THEN array_to_string({_IDENT}, '|')
    WHEN kind = 'foreach' THEN 'dbl|grp.region|j.v|max_v|name|region|total|v'
    ELSE '' END AS columns
FROM b
""")
def pig_transformations(spark, folder):
    return pig.pig_transformations(files(spark, folder, ".pig"))


@query("classify_join", views=("files",), oracle=f"""
WITH j AS (SELECT file_id, unnest({find(pig.STATEMENTS['join'], 0)}) AS statement FROM ({PIG_FILES}) f)
SELECT file_id, statement, regexp_extract(statement, {lit(pig.STATEMENTS['join'])}, 3) AS keys,
  CASE WHEN contains(upper(statement), 'LEFT') THEN 'LEFT OUTER JOIN' WHEN contains(upper(statement), 'FULL OUTER') THEN 'FULL OUTER JOIN' ELSE 'INNER JOIN' END AS join_type,
  array_to_string(list_transform(string_split(regexp_extract(statement, {lit(pig.STATEMENTS['join'])}, 3), ','), lambda v: trim(string_split(v, '::')[-1])), '|') AS join_keys
FROM j
""")
def classify_join(spark, folder):
    p = pig.STATEMENTS["join"]
    rows = files(spark, folder, ".pig").select("file_id", F.explode(find_all("content", p, 0)).alias("statement"))
    return pig.classify_join(rows.withColumn("keys", F.regexp_extract("statement", p, 3)))


@query("predicate_columns", views=("files",), oracle=f"""
WITH c AS (SELECT file_id, unnest({find(pig.STATEMENTS['filter'], 3)}) AS body FROM ({PIG_FILES}) f)
SELECT file_id, body AS condition, array_to_string({_IDENT}, '|') AS columns FROM c
""")
def predicate_columns(spark, folder):
    rows = files(spark, folder, ".pig").select(
        "file_id", F.explode(find_all("content", pig.STATEMENTS["filter"], 3)).alias("condition"))
    return pig.predicate_columns(rows)


@query("projection_parts", views=("scripts",), oracle=f"""
WITH p AS (SELECT script_id, unnest({find(pig.STATEMENTS['foreach'], 3)}) AS projections FROM scripts),
part_rows AS (SELECT script_id, projections, trim(unnest(string_split(projections, ','))) AS part FROM p),
refs AS (SELECT script_id, projections, unnest(regexp_extract_all(part, {lit(pig.COLUMN_REF)}, 1)) AS c FROM part_rows)
SELECT script_id, projections, string_agg(DISTINCT c, '|' ORDER BY c) AS columns, '' AS functions, {_HAS_AGG.format('projections')} AS is_aggregate
FROM refs WHERE upper(c) NOT IN ('AS', 'AND', 'OR') GROUP BY script_id, projections
""")
def projection_parts(spark, folder):
    rows = view(spark, folder, "scripts").select(
        "script_id", F.explode(find_all("content", pig.STATEMENTS["foreach"], 3)).alias("projections"))
    return pig.projection_parts(rows)


@query("column_lineage", views=("files",), oracle=f"""
WITH m AS (SELECT file_id, unnest({find(pig.STATEMENTS['foreach'], 0)}) AS x FROM ({PIG_FILES}) f),
p AS (SELECT file_id, regexp_extract(x, {lit(pig.STATEMENTS['foreach'])}, 2) AS source_table, regexp_extract(x, {lit(pig.STATEMENTS['foreach'])}, 1) AS target_table,
  trim(unnest(string_split(regexp_extract(x, {lit(pig.STATEMENTS['foreach'])}, 3), ','))) AS proj FROM m),
e AS (SELECT *, CASE WHEN contains(upper(proj), ' AS ') THEN trim(regexp_split_to_array(proj, '(?i)\\s+AS\\s+')[1]) ELSE proj END AS expression,
  CASE WHEN contains(upper(proj), ' AS ') THEN trim(regexp_split_to_array(proj, '(?i)\\s+AS\\s+')[2]) ELSE proj END AS target_column FROM p),
k AS (SELECT *, CASE WHEN contains(expression, '.') AND NOT contains(expression, '(') THEN 'pass_through'
  WHEN regexp_matches(expression, '[-+*/(]|CASE|IF') THEN 'calculated' WHEN {_HAS_AGG.format('expression')} THEN 'aggregated' END AS lineage_kind FROM e)
SELECT file_id, source_table, target_table, expression, target_column, lineage_kind,
  CASE lineage_kind WHEN 'pass_through' THEN string_split(expression, '.')[-1] ELSE lineage_kind END AS source_column
FROM k WHERE lineage_kind IS NOT NULL
""")
def column_lineage(spark, folder):
    return pig.column_lineage(files(spark, folder, ".pig"))


@query("script_flags", views=("files",), oracle="""
WITH u AS (SELECT file_id, content, upper(content) AS up FROM files)
SELECT file_id, array_to_string(list_filter([
  CASE WHEN contains(up, 'IS NOT NULL') THEN 'null_check' END,
  CASE WHEN contains(up, 'ISEMPTY') OR contains(up, 'IS NULL') THEN 'empty_check' END,
  CASE WHEN contains(up, 'AGE') AND (contains(content, '> 18') OR contains(content, '>= 18')) THEN 'adult_filter' END,
  CASE WHEN contains(up, 'STATUS') AND contains(up, 'ACTIVE') THEN 'active_filter' END,
  CASE WHEN contains(up, 'DATE') AND (contains(up, 'CURRENT') OR contains(up, 'TODAY')) THEN 'current_date' END,
  CASE WHEN contains(up, 'DISTINCT') THEN 'deduplication' END,
  CASE WHEN (length(up) - length(replace(up, 'JOIN', ''))) / 4 > 3 THEN 'many_joins' END,
  CASE WHEN contains(up, 'GROUP BY') AND contains(up, 'ALL') THEN 'group_all' END], lambda x: x IS NOT NULL), '|') AS flags
FROM u
""")
def script_flags(spark, folder):
    return pig.script_flags(files(spark, folder))


def _typed(pattern, direction):
    return (f"SELECT file_id, '{direction}' AS direction, unnest(regexp_extract_all(content, {lit(pattern)}, 1)) AS path FROM ({PY_FILES}) f")


@query("pyspark_io", views=("files",), oracle=f"""
SELECT DISTINCT file_id, direction, CASE WHEN path LIKE '/%' OR path LIKE 'dbfs:%' THEN 'file' ELSE 'table' END AS location_type, path FROM (
{' UNION ALL '.join([_typed(p, 'read') for p in spk.READS] + [_typed(p, 'write') for p in spk.WRITES])}) hits
""")
def pyspark_io(spark, folder):
    return spk.pyspark_io(files(spark, folder, ".py"))


_TRIM_Q = "list_transform(string_split({0}, ','), lambda v: trim(trim(v), '\"'''))"


@query("pyspark_transformations", views=("files",), oracle=f"""
WITH f AS ({PY_FILES}), m AS (
  SELECT file_id, 1 AS grp, unnest({find(spk.FILTER, 0)}) AS x, generate_subscripts({find(spk.FILTER, 0)}, 1) AS i FROM f
  UNION ALL SELECT file_id, 2, unnest({find(spk.JOIN, 0)}), generate_subscripts({find(spk.JOIN, 0)}, 1) FROM f
  UNION ALL SELECT file_id, 3, unnest({find(spk.GROUP, 0)}), generate_subscripts({find(spk.GROUP, 0)}, 1) FROM f
  UNION ALL SELECT file_id, 4, unnest({find(spk.SELECT, 0)}), generate_subscripts({find(spk.SELECT, 0)}, 1) FROM f),
h AS (SELECT *, CASE WHEN grp = 2 THEN coalesce(nullif(regexp_extract(x, {lit(spk.JOIN)}, 3), ''), 'inner') END AS how FROM m)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY grp, i) AS step_no,
  CASE grp WHEN 1 THEN 'filter' WHEN 2 THEN CASE how WHEN 'inner' THEN 'join' ELSE 'left_join' END WHEN 3 THEN 'group_by' ELSE 'transform' END AS kind,
  x AS snippet, CASE grp WHEN 1 THEN trim(regexp_extract(x, {lit(spk.FILTER)}, 1)) WHEN 2 THEN trim(regexp_extract(x, {lit(spk.JOIN)}, 2)) END AS condition,
  CASE grp WHEN 2 THEN concat(upper(how), ' JOIN') END AS join_type,
  CASE grp WHEN 3 THEN array_to_string({_TRIM_Q.format(f"regexp_extract(x, {lit(spk.GROUP)}, 1)")}, '|')
    WHEN 4 THEN array_to_string({_TRIM_Q.format(f"regexp_extract(x, {lit(spk.SELECT)}, 1)")}, '|') ELSE '' END AS columns
FROM h
""")
def pyspark_transformations(spark, folder):
    return spk.pyspark_transformations(files(spark, folder, ".py"))


_CLASS = f"""
SELECT file_id, path, content, upper(content) AS up, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext FROM files"""
_DEF = "(ext IN ('.sql', '.hql') AND contains(up, 'CREATE') AND contains(up, 'TABLE') AND NOT contains(up, 'INSERT'))"
_LOADS = f"(ext IN ('.sql', '.hql') AND NOT {_DEF} AND contains(up, 'INSERT') AND contains(up, 'SELECT'))"
_ASKS = f"(ext IN ('.sql', '.hql') AND NOT {_DEF} AND NOT contains(up, 'INSERT') AND contains(up, 'SELECT'))"
_SHW = f"regexp_matches(content, {lit(sc.SHELL_WRITE)})"
_SHQ = f"regexp_matches(content, {lit(sc.SHELL_QUERY)})"


@query("classify_scripts", views=("files",), oracle=f"""
WITH f AS ({_CLASS})
SELECT file_id, path, CASE WHEN {_DEF} THEN 'definition' WHEN {_LOADS} THEN 'transform' WHEN {_ASKS} THEN 'consumer'
  WHEN ext IN ('.pig', '.py') THEN 'transform' WHEN ext = '.xml' THEN 'orchestrator'
  WHEN ext = '.sh' AND {_SHW} THEN CASE WHEN {_SHQ} THEN 'transform' ELSE 'source' END
  WHEN ext = '.sh' AND {_SHQ} AND NOT regexp_matches(content, '(?i)INSERT\\s+INTO') THEN 'consumer' ELSE 'unknown' END AS script_class
FROM f
""")
def classify_scripts(spark, folder):
    return sc.classify_scripts(files(spark, folder, columns=("file_id", "path", "content")))


LOCATIONS_SQL = f"""
SELECT DISTINCT file_id, direction, location_type, location FROM (
  SELECT file_id, 'write' AS direction, 'hive_table' AS location_type, regexp_extract(content, {lit(sc.DDL_TABLE)}, 1) AS location FROM cls WHERE {_DEF}
  UNION ALL SELECT file_id, 'write', 'hdfs_path', unnest(regexp_extract_all(content, {lit(sc.DDL_LOCATION)}, 1)[1:1]) FROM cls WHERE {_DEF}
  UNION ALL SELECT file_id, 'write', 'hive_table', unnest({find(sc.INSERT_NAME)}) FROM cls WHERE {_LOADS}
  UNION ALL SELECT file_id, 'read', 'hive_table', unnest({find(sc.FROM_NAME)}) FROM cls WHERE {_LOADS} OR {_ASKS}
  UNION ALL SELECT file_id, 'read', 'hdfs_path', unnest({find(sc.PIG_LOAD)}) FROM cls WHERE ext = '.pig'
  UNION ALL SELECT file_id, 'write', 'hdfs_path', unnest({find(sc.PIG_STORE)}) FROM cls WHERE ext = '.pig'
  UNION ALL SELECT file_id, 'write', 'file', unnest({find(sc.SHELL_TARGET)}) FROM cls WHERE ext = '.sh' AND {_SHW}
  UNION ALL SELECT file_id, 'read', 'hive_table', unnest({find(sc.FROM_OR_JOIN_NAME)}) FROM cls WHERE ext = '.sh'
  UNION ALL SELECT file_id, 'read', CASE WHEN contains(content, 'spark.read.table') THEN 'table' ELSE 'hdfs_path' END, unnest({find(sc.SPARK_READ)}) FROM cls WHERE ext = '.py'
  UNION ALL SELECT file_id, 'write', CASE WHEN contains(content, 'saveAsTable') THEN 'table' ELSE 'hdfs_path' END, unnest({find(sc.SPARK_WRITE)}) FROM cls WHERE ext = '.py') l
"""


@query("script_locations", views=("files",), oracle=f"WITH cls AS ({_CLASS}) {LOCATIONS_SQL}")
def script_locations(spark, folder):
    rows = sc.script_locations(files(spark, folder, columns=("file_id", "path", "content")))
    return rows.drop("path")


_RE = lambda p: f"regexp_matches(content, {lit(p)})"


@query("transformation_kinds", views=("files",), oracle=f"""
WITH f AS ({_CLASS})
SELECT file_id, path, array_to_string(list_filter(CASE
  WHEN {_LOADS} THEN [CASE WHEN contains(up, 'WHERE') OR contains(up, 'FILTER') THEN 'filter' END, CASE WHEN contains(up, 'JOIN') THEN 'join' END,
    CASE WHEN contains(up, 'GROUP BY') THEN 'aggregate' END, CASE WHEN contains(up, 'DISTINCT') THEN 'distinct' END,
    CASE WHEN contains(up, 'ORDER BY') OR contains(up, 'SORT BY') THEN 'sort' END]
  WHEN ext = '.pig' THEN [{', '.join(f"CASE WHEN {_RE(p)} THEN '{k}' END" for k, p in sc.KIND_PATTERNS['pig'].items())}]
  WHEN ext = '.py' THEN [{', '.join(f"CASE WHEN {_RE(p)} THEN '{k}' END" for k, p in sc.KIND_PATTERNS['python'].items())}]
  ELSE [] END, lambda x: x IS NOT NULL), '|') AS kinds FROM f
""")
def transformation_kinds(spark, folder):
    return sc.transformation_kinds(files(spark, folder, columns=("file_id", "path", "content")))


@query("file_references", views=("files",), oracle="SELECT DISTINCT file_id, reference FROM (" + " UNION ALL ".join(
    f"SELECT file_id, unnest({find(p)}) AS reference FROM files" for p in vocab.FILE_REFERENCE_PATTERNS) + ") r")
def file_references(spark, folder):
    return sc.file_references(files(spark, folder))


@query("sttm_from_ddl", views=("files",), oracle=f"""
WITH f AS (SELECT file_id, path, content FROM files WHERE path LIKE '%.hql' OR path LIKE '%.sql'),
t AS (SELECT DISTINCT file_id, unnest(list_concat({find(sc.INSERT_NAME)}, {find(sc.DDL_TARGET)})) AS target_table FROM f),
c AS (SELECT file_id, path, unnest({find(sc.TYPED_COLUMN)}[1:20]) AS target_column, generate_subscripts({find(sc.TYPED_COLUMN)}[1:20], 1) - 1 AS processing_order FROM f)
SELECT file_id, target_table, target_column, processing_order,
  concat(regexp_extract(path, '([^/]*)\\.[^./]*$', 1), '_', target_table, '_', target_column, '_', CAST(processing_order AS VARCHAR)) AS mapping_key
FROM t JOIN c USING (file_id)
""")
def sttm_from_ddl(spark, folder):
    return sc.sttm_from_ddl(files(spark, folder, ".hql", ".sql", columns=("file_id", "path", "content")), 20).drop("path")


@query("business_keywords", oracle=f"""
SELECT doc_id, array_to_string(list_sort(list_filter({lit_list(vocab.BUSINESS_TERMS)}, lambda w: contains(lower(text), w))), '|') AS keywords,
  array_to_string(list_sort(list_filter({lit_list(vocab.DOMAIN_KEYWORDS)}, lambda w: contains(lower(text), w))), '|') AS domains
FROM documents
""")
def business_keywords(spark, folder):
    docs = texts(spark, folder)
    return sc.business_keywords(docs).select(
        "doc_id", "keywords", contained_words("text", vocab.DOMAIN_KEYWORDS).alias("domains"))


@query("assess_logic", views=("files",), oracle="""
WITH f AS (SELECT file_id, content, lower(content) AS low, length(content) - length(replace(content, chr(10), '')) + 1 AS n FROM files)
SELECT file_id, CASE WHEN contains(low, 'customer') THEN 'Customer data processing' WHEN contains(low, 'product') THEN 'Product information management'
  WHEN contains(low, 'order') THEN 'Order processing' WHEN contains(low, 'aggregate') OR contains(low, 'sum') THEN 'Data aggregation and summarization'
  WHEN contains(low, 'join') THEN 'Data enrichment through joins' WHEN contains(low, 'filter') OR contains(low, 'where') THEN 'Data filtering and selection'
  ELSE 'Data transformation' END AS purpose,
 array_to_string(list_filter([CASE WHEN contains(low, 'not null') THEN 'NULL_CHECK' END, CASE WHEN contains(low, 'distinct') THEN 'DEDUPLICATION' END,
  CASE WHEN regexp_matches(low, 'trim|strip') THEN 'WHITESPACE_TRIMMING' END, CASE WHEN regexp_matches(low, 'upper|lower') THEN 'CASE_STANDARDIZATION' END,
  CASE WHEN regexp_matches(low, 'cast|convert') THEN 'TYPE_CONVERSION' END], lambda x: x IS NOT NULL), '|') AS quality_rules,
 CASE WHEN n > 50 OR (contains(content, ')') AND length(content) - length(replace(content, '(', '')) > 2)
   OR CAST(contains(low, 'join') AS INT) + CAST(contains(low, 'filter') AS INT) + CAST(contains(low, 'group') AS INT) + CAST(contains(low, 'aggregate') AS INT) > 2 THEN 'HIGH'
   WHEN n > 20 THEN 'MEDIUM' ELSE 'LOW' END AS complexity
FROM f
""")
def assess_logic(spark, folder):
    return sc.assess_logic(files(spark, folder)).drop("content")


@query("feed_sections", views=("files",), oracle=f"""
WITH f AS ({SQL_FILES})
SELECT file_id, 'flag' AS section, 'COMBINE FILES' AS name, '' AS detail, CASE WHEN regexp_matches(upper(content), '\\bUNION\\b') THEN 'Yes' ELSE 'No' END AS value FROM f
UNION ALL SELECT file_id, 'flag', 'MULTIPLE FILES', '', CASE WHEN len(list_distinct(list_concat(list_filter({find(sql.FROM_TABLE)}, lambda t: upper(t) NOT IN ('SELECT', 'WHERE', 'GROUP')), {find(sql.JOIN_TABLE)}))) > 1 THEN 'Yes' ELSE 'No' END FROM f
UNION ALL SELECT file_id, 'flag', 'ADDITIONAL RECORDS', '', CASE WHEN regexp_matches(upper(content), '\\b(INSERT|UPDATE)\\b') THEN 'Yes' ELSE 'No' END FROM f
UNION ALL SELECT file_id, 'validation', 'WHERE', '', trim(unnest(regexp_split_to_array(w, '(?i)\\sAND\\s')), concat(' ', chr(10))) FROM (SELECT file_id, unnest({find(sql.WHERE_CLAUSE)}) AS w FROM f) ws
UNION ALL SELECT file_id, 'join', upper(trim(regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 1), concat(' ', chr(10)))), regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 2),
  trim(regexp_extract(x, {lit(sql.JOIN_CLAUSE)}, 3), concat(' ', chr(10))) FROM (SELECT file_id, unnest({find(sql.JOIN_CLAUSE, 0)}) AS x FROM f) js
""")
def feed_sections(spark, folder):
    return sql.feed_sections(files(spark, folder, ".hql", ".sql"))


@query("path_group", views=("files",), oracle="""
WITH f AS (SELECT file_id, list_filter(string_split(path, '/'), lambda p: p <> '') AS p FROM files)
SELECT file_id, p[1] AS top, concat(p[1], '/', p[2]) AS first_two,
  CASE WHEN p[2] IN ('workflows', 'oozie') THEN p[3] ELSE p[-2] END AS module FROM f
""")
def path_group(spark, folder):
    return files(spark, folder, columns=("file_id", "path")).select(
        "file_id", sc.path_group("path", "top").alias("top"), sc.path_group("path", "first_two").alias("first_two"),
        sc.path_group("path", "module").alias("module"))


@query("detect_projects", views=("files",), oracle="""
WITH f AS (SELECT string_split(path, '/') AS p FROM files)
SELECT p[2] AS project, count(DISTINCT p[3]) AS indicators, string_agg(DISTINCT p[3], '|' ORDER BY p[3]) AS subfolders
FROM f WHERE p[3] IN ('mp', 'dml', 'components', 'pset', 'plan') GROUP BY p[2] HAVING count(DISTINCT p[3]) >= 2
""")
def detect_projects(spark, folder):
    return sc.detect_projects(files(spark, folder, columns=("path",)))


@query("usable_scripts", views=("scripts",), oracle="""
SELECT script_id, len(regexp_extract_all(content, '(?i)\\bFROM\\s+([a-zA-Z0-9_\\.]+)', 1)) AS n_reads FROM scripts
WHERE length(trim(content)) >= 100 AND (regexp_matches(content, '(?i)\\b(FROM|JOIN)\\s+[a-zA-Z0-9_\\.]+') OR regexp_matches(content, '(?i)\\bINSERT\\s+'))
""")
def usable_scripts(spark, folder):
    rows = view(spark, folder, "scripts").withColumn("reads", sql.sql_reads()).withColumn("writes", sql.sql_writes())
    return sc.usable(rows).select("script_id", F.size(find_all("content", sql.FROM_TABLE)).alias("n_reads"))


@query("filter_names", views=("files",), oracle="""
SELECT file_id, path FROM files WHERE regexp_matches(lower(regexp_extract(path, '([^/]*)\\.[^./]*$', 1)), 'f1|9|work')
""")
def filter_names(spark, folder):
    return sc.filter_names(files(spark, folder, columns=("file_id", "path")), ["F1", "9", "Work"])


@query("script_inventory", views=("files",), oracle="""
WITH f AS (SELECT string_split(path, '/')[2] AS repo, regexp_extract(path, '([^/]*)$', 1) AS name, length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END AS lines,
  CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'py' THEN 'PySpark' WHEN 'pig' THEN 'Pig' WHEN 'sh' THEN 'Shell' WHEN 'sql' THEN 'Hive' WHEN 'hql' THEN 'Hive' END AS script_type
  FROM files WHERE NOT contains(path, '.git') AND NOT contains(path, '__pycache__') AND NOT contains(path, 'target') AND NOT contains(path, 'build')),
r AS (SELECT DISTINCT regexp_extract(unnest(regexp_extract_all(content, '<script>([^<]+)</script>', 1)), '([^/]*)$', 1) AS name FROM files WHERE path LIKE '%.xml')
SELECT repo, script_type, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(r.name) AS used, count(*) - count(r.name) AS unused
FROM f LEFT JOIN r ON f.name = r.name WHERE script_type IS NOT NULL GROUP BY repo, script_type
""")
def script_inventory(spark, folder):
    all_files = files(spark, folder, columns=("path", "content"))
    refs = files(spark, folder, ".xml", columns=("path", "content")).select(
        F.explode(find_all("content", r"<script>([^<]+)</script>")).alias("ref"))
    return sc.script_inventory(all_files, refs.select(file_name("ref").alias("name")))
