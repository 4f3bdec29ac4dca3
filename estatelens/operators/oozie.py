"""Facts from workflow and coordinator XML. Each document is parsed once into a struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs
from estatelens.functions.text import as_col, contains_any, file_name, find_all, find_many, words

WORKFLOW_SCHEMA = """
action ARRAY<STRUCT<
  _name: STRING,
  spark: STRUCT<master: STRING, jar: STRING, class: STRING, arg: ARRAY<STRING>>,
  hive: STRUCT<script: STRING, query: STRING>,
  pig: STRUCT<script: STRING, param: ARRAY<STRING>>,
  sqoop: STRUCT<command: STRING>,
  shell: STRUCT<exec: STRING, argument: ARRAY<STRING>>,
  java: STRUCT<`main-class`: STRING>,
  `map-reduce`: STRUCT<script: STRING>,
  `sub-workflow`: STRUCT<`app-path`: STRING, configuration: STRUCT<property: ARRAY<STRUCT<name: STRING, value: STRING>>>>,
  workflow: STRUCT<`app-path`: STRING>
>>
"""
# --- Fixed values: patterns on workflow XML and its queries ------------------------
ROOT_TAG = r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)"
QUERY_TABLES = [r"(?i)FROM\s+([a-zA-Z0-9_]+)", r"(?i)JOIN\s+([a-zA-Z0-9_]+)",
                r"(?i)INTO\s+TABLE\s+([a-zA-Z0-9_]+)", r"(?i)INTO\s+([a-zA-Z0-9_]+)"]
FREQUENCY = r'<[^>]*coordinator-app[^>]*\sfrequency="([^"]*)"'
SCRIPT_TAGS = r"<(?:[\w-]+:)?(?:script|file|exec|jar|app-path|main-class)>([^<]*)</"
TABLE_PROPERTY = r"<name>table</name>\s*<value>([^<]+)</value>"
HDFS_PATH = r'hdfs://[^<>"\s]+'
VARIABLE = r"\$\{([^}]+)\}"


def root_tag(content) -> Column:
    return F.regexp_extract(as_col(content), ROOT_TAG, 1)


def select_workflow_files(files: DataFrame) -> DataFrame:
    """XML files that are workflows or coordinators by file name or folder."""
    name = file_name("path")
    folders = F.split("path", "/")
    by_name = name.isin("workflow.xml", "coordinator.xml") | name.endswith("_workflow.xml") | name.endswith("_coordinator.xml")
    return files.filter(name.endswith(".xml") & (by_name | F.array_contains(folders, "oozie")
                                                 | F.array_contains(folders, "coordinators")))


def skip_file(path) -> Column:
    return F.exists(words(vocab.SKIP_FOLDERS), lambda w: as_col(path).contains(w)) | F.exists(
        words(vocab.BACKUP_SUFFIXES), lambda w: as_col(path).endswith(w))


def detect_workflows(files: DataFrame) -> DataFrame:
    """Workflow and coordinator files by root tag; of workflows with one name the first path stays."""
    rows = files.filter(~skip_file("path")).select("path", root_tag("content").alias("root"),
                                                   F.regexp_extract("content", r'<[\w.:-]*workflow-app[^>]*?\sname="([^"]*)"', 1).alias("name"))
    key = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("path"))
    flows = rows.filter(F.col("root") == "workflow-app").groupBy(key.alias("name")).agg(F.min("path").alias("path"))
    coords = rows.filter(F.col("root") == "coordinator-app")
    return flows.select(F.lit("workflow").alias("kind"), "name", "path").unionByName(
        coords.select(F.lit("coordinator").alias("kind"), "name", "path"))


def parsed(files: DataFrame) -> DataFrame:
    """Adds the parsed document as column `wf`; broken XML gives null."""
    return files.withColumn("wf", F.from_xml("content", WORKFLOW_SCHEMA, {"ignoreNamespace": "true"}))


NO_STRINGS = "array<string>"


def _side(values, words_) -> Column:
    return F.filter(values, lambda v: contains_any(F.lower(v), words_))


def _param_parts(params):
    split = F.transform(F.filter(params, lambda p: p.contains("=")),
                        lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"),
                                           F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value")))
    return split


def oozie_actions(files: DataFrame) -> DataFrame:
    """One row per action: name, type, script, parameters, inputs and outputs by keyword."""
    keep = [c for c in files.columns if c != "content"]
    # the attribute comes from the text: a second use of the parsed struct would parse again
    rows = parsed(files).select(*keep, F.nullif(F.regexp_extract("content", FREQUENCY, 1), F.lit("")).alias("frequency"),
                                F.explode("wf.action").alias("a"))
    none = F.array().cast(NO_STRINGS)
    has = lambda t: F.col(f"a.`{t}`").isNotNull()
    kind = F.coalesce(*[F.when(has(t), t) for t in vocab.ACTION_TYPES], F.when(has("workflow"), "coordinator"), F.lit("unknown"))
    script = F.coalesce(*[F.when(has(t), F.col(f"a.{t}.{f}")) for t, f in
                          (("spark", "jar"), ("hive", "script"), ("pig", "script"), ("shell", "exec"))], F.lit(""))
    args = lambda t, f: F.transform(F.coalesce(F.col(f"a.{t}.{f}"), none), lambda x: F.trim(x))
    in_words, out_spark, out_shell = ["table", "input", "source"], ["output", "target", "dest"], ["output", "target"]
    by_args = lambda values, outs: (_side(values, in_words), F.filter(
        values, lambda v: contains_any(F.lower(v), outs) & ~contains_any(F.lower(v), in_words)))
    spark_in, spark_out = by_args(args("spark", "arg"), out_spark)
    shell_in, shell_out = by_args(args("shell", "argument"), out_shell)
    params = _param_parts(args("pig", "param"))
    named = F.filter(params, lambda p: contains_any(F.lower(p["key"]), in_words + out_shell))
    is_in = lambda p: contains_any(F.lower(p["key"]), ["input", "source"])
    pig_in = F.transform(F.filter(named, is_in), lambda p: p["value"])
    pig_out = F.transform(F.filter(named, lambda p: ~is_in(p)), lambda p: p["value"])
    hive_in = F.array_distinct(find_many(F.coalesce("a.hive.query", F.lit("")), QUERY_TABLES))
    one = lambda p: F.filter(F.array(F.regexp_extract(F.coalesce("a.sqoop.command", F.lit("")), p, 1)), lambda v: v != "")
    pick = lambda spark_, hive, pig, sqoop, shell: (
        F.when(has("spark"), spark_).when(has("hive"), hive).when(has("pig"), pig)
        .when(has("sqoop"), sqoop).when(has("shell"), shell).otherwise(none))
    trigger = F.array(F.concat(F.lit("frequency="), F.coalesce("frequency", F.lit("unknown"))),
                      F.concat(F.lit("referenced_workflow="), F.col("a.workflow.`app-path`")))
    name = F.when(has("workflow"), "coordinator_trigger").otherwise(F.coalesce("a._name", F.lit("unknown")))
    runs = F.array_compact(F.array(F.concat(F.lit("master="), F.nullif(F.col("a.spark.master"), F.lit(""))),
                                   F.concat(F.lit("main_class="), F.nullif(F.col("a.spark.class"), F.lit("")))))
    return rows.select(
        *keep, name.alias("action"), kind.alias("action_type"), script.alias("script"),
        F.when(has("workflow"), trigger).when(has("spark"), runs).otherwise(
            F.transform(params, lambda p: F.concat_ws("=", p["key"], p["value"]))).alias("parameters"),
        pick(spark_in, hive_in, pig_in, one(r"--table\s+(\S+)"), shell_in).alias("inputs"),
        pick(spark_out, none, pig_out, one(r"--target-dir\s+(\S+)"), shell_out).alias("outputs"))


def subworkflow_properties(files: DataFrame) -> DataFrame:
    """Rows (app_path, key, value) of the properties passed to sub-workflows."""
    keep = [c for c in files.columns if c != "content"]
    rows = parsed(files).select(*keep, F.explode("wf.action").alias("a")).filter(F.col("a.`sub-workflow`.`app-path`").isNotNull())
    return rows.select(*keep, F.trim("a.`sub-workflow`.`app-path`").alias("app_path"),
                       F.explode("a.`sub-workflow`.configuration.property").alias("p")) \
        .select(*keep, "app_path", F.trim("p.name").alias("key"), F.trim("p.value").alias("value"))


def subworkflow_io(properties: DataFrame) -> DataFrame:
    """Inputs and outputs named by passed properties; unresolved variables are left out."""
    low = F.lower("key")
    side = (F.when(low.contains("input") | low.contains("source"), "input")
            .when(low.contains("output") | low.contains("target"), "output").otherwise("input"))
    return properties.filter(F.col("key").isin(*vocab.SUBWORKFLOW_KEYS) & (F.col("value") != "")
                             & ~F.col("value").startswith("${")).withColumn("direction", side)


def resolved(text, properties) -> Column:
    """The text with `${name}` replaced from a map.

    Names that look like function calls become `<name>`; unknown names stay as they are.
    """
    pieces = F.split(as_col(text), VARIABLE)
    names = find_all(text, VARIABLE)
    values = F.transform(names, lambda n: F.when(n.contains(":") | n.contains("("), F.concat(F.lit("<"), n, F.lit(">")))
                         .otherwise(F.coalesce(F.try_element_at(as_col(properties), n),
                                               F.concat(F.lit("${"), n, F.lit("}")))))
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(values, i), F.lit("")))), "")


def resolve_variables(df: DataFrame, text: str, properties: str) -> DataFrame:
    """Replaces `${name}` in a text column from a map column (see `resolved`)."""
    return df.withColumn(text, resolved(F.col(text), properties))


def resolve_actions(actions: DataFrame, properties: DataFrame, group: str) -> DataFrame:
    """Actions with the variables in their inputs and outputs replaced.

    `properties` has (group, properties), one map per group as `property_map` makes it; actions of a
    group without one keep their unknown names.
    """
    rows = actions.join(properties.select(group, F.col("properties").alias("_known")), group, "left")
    none = F.create_map().cast("map<string, string>")
    known = F.coalesce("_known", none)
    return rows.withColumns({c: F.transform(c, lambda v: resolved(v, known)) for c in ("inputs", "outputs")}).select(*actions.columns)


def workflow_facts(files: DataFrame) -> DataFrame:
    """Per document: number of actions, referenced script file names, tables."""
    refs = F.transform(find_all("content", SCRIPT_TAGS), lambda t: F.trim(t))
    refs = F.filter(refs, lambda t: (t != "") & ~t.contains("$"))
    names = F.transform(refs, lambda t: F.element_at(F.split(t, "/"), -1))
    scripts = F.filter(names, lambda n: F.exists(words(vocab.WORKFLOW_SCRIPT_SUFFIXES), lambda s: n.endswith(s)))
    skip = words(vocab.HDFS_SKIP_SEGMENTS)

    def last_segment(path):
        good = F.filter(F.split(path, "/"), lambda s: (F.length(s) > 1) & ~s.startswith("$"))
        return F.when(~F.arrays_overlap(F.split(path, "/"), skip), F.get(good, F.size(good) - 1))

    tables = F.concat(F.array_compact(F.transform(find_all("content", HDFS_PATH, 0), last_segment)),
                      find_all("content", TABLE_PROPERTY))
    keep = [c for c in files.columns if c != "content"]
    return files.select(
        *keep, F.size(find_all("content", r"<(?:[\w-]+:)?(action)[\s>]")).alias("actions"),
        F.array_sort(F.array_distinct(scripts)).alias("scripts"),
        F.array_sort(F.array_distinct(tables)).alias("tables"))


def read_properties(files: DataFrame) -> DataFrame:
    """Rows (entry_no, key, value) of `key=value` lines; comments skipped, the first `=` splits."""
    lines = F.transform(F.split("content", "\n"), lambda l: F.trim(l))
    good = F.filter(lines, lambda l: (l != "") & ~l.startswith("#") & l.contains("="))
    return explode_structs(files, F.transform(good, lambda l: F.struct(
        F.trim(F.substring_index(l, "=", 1)).alias("key"),
        F.trim(F.substring(l, F.instr(l, "=") + 1, F.length(l))).alias("value"))), ordinal="entry_no")


def property_map(properties: DataFrame, group: str) -> DataFrame:
    """Properties of one file as a map; the last value of a key wins. A file bounds its size."""
    last = properties.groupBy(group, "key").agg(F.max_by("value", "entry_no").alias("value"))
    return last.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
