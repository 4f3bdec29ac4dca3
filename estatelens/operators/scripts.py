"""Facts that hold for any script file: class, locations, kinds, references, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs, explode_values
from estatelens.functions.text import (
    as_col, contained_words, contains_any, extension, file_lines, file_name, file_stem, find_all, find_many,
    line_count, words,
)

# --- Fixed values: patterns on script files -----------------------------------
DDL_TABLE = r"(?i)CREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
DDL_LOCATION = r"(?i)LOCATION\s+'([^']+)'"
INSERT_NAME = r"(?i)INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?(\w+)"
FROM_NAME = r"(?i)\bFROM\s+(\w+)"
FROM_OR_JOIN_NAME = r"(?i)\b(?:FROM|JOIN)\s+(\w+)"
PIG_LOAD = r"(?i)LOAD\s+'([^']+)'"
PIG_STORE = r"(?i)STORE\s+\w+\s+INTO\s+'([^']+)'"
SHELL_WRITE = r"(echo.+?>>|scp.+?:|hdfs\s+dfs\s+-put|hadoop\s+fs\s+-put)"
SHELL_QUERY = r'(?i)hive\s+-e\s+"SELECT'
SHELL_INSERT = r"(?i)INSERT\s+INTO"
SHELL_TARGET = r"echo.+?>>\s*([^\s;]+)"
SPARK_READ = r"""spark\.read\.(?:table|parquet|csv|json)\(["']([^"']+)["']\)"""
SPARK_WRITE = r"""\.(?:saveAsTable|write\.parquet|write\.csv)\(["']([^"']+)["']\)"""
KIND_PATTERNS = {
    "pig": {"filter": r"(?i)\bFILTER\b", "join": r"(?i)\bJOIN\b",
            "aggregate": r"(?i)\bGROUP\b", "distinct": r"(?i)\bDISTINCT\b"},
    "python": {"filter": r"\.filter\(|\.where\(", "join": r"\.join\(",
               "aggregate": r"\.groupBy\(|\.agg\(", "distinct": r"\.distinct\(|\.dropDuplicates\("},
}
DDL_TARGET = r"(?i)CREATE\s+(?:TABLE|EXTERNAL\s+TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
TYPED_COLUMN = r"(?i)(\w+)\s+(?:STRING|INT|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP)"
NO_STRINGS = "array<string>"


class _Facts:
    """Shared conditions on one file's text, by extension."""

    def __init__(self, path="path", content="content"):
        self.text = as_col(content)
        self.up = F.upper(self.text)
        ext = extension(path)
        self.sql = ext.isin(".sql", ".hql", ".hive")
        self.pig, self.shell = ext == ".pig", ext == ".sh"
        self.python, self.xml = ext == ".py", ext == ".xml"
        has_create = self.up.contains("CREATE") & self.up.contains("TABLE")
        has_insert, has_select = self.up.contains("INSERT"), self.up.contains("SELECT")
        self.define = self.sql & has_create & ~has_insert
        self.load = self.sql & ~self.define & has_insert & has_select
        self.query = self.sql & ~self.define & has_select & ~has_insert
        self.writes_out = self.text.rlike(SHELL_WRITE)
        self.asks = self.text.rlike(SHELL_QUERY)


def script_class(path="path", content="content") -> Column:
    f = _Facts(path, content)
    return (
        F.when(f.define, "definition").when(f.load, "transform").when(f.query, "consumer")
        .when(f.pig | f.python, "transform").when(f.xml, "orchestrator")
        .when(f.shell & f.writes_out, F.when(f.asks, "transform").otherwise("source"))
        .when(f.shell & f.asks & ~f.text.rlike(SHELL_INSERT), "consumer")
        .otherwise("unknown")
    )


def classify_scripts(files: DataFrame) -> DataFrame:
    """Class of every file: source, transform, consumer, definition, orchestrator, unknown."""
    return files.withColumn("script_class", script_class()).drop("content")


def script_locations(files: DataFrame) -> DataFrame:
    """Rows (direction, location_type, path) of the data a script reads and writes."""
    f = _Facts()

    def locs(cond, direction, kind, values):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(cond, F.transform(values, lambda v: F.struct(
            F.lit(direction).alias("direction"), kind.alias("location_type"), v.alias("location")))) \
            .otherwise(F.array().cast("array<struct<direction:string,location_type:string,location:string>>"))

    first = lambda a: F.slice(a, 1, 1)
    ddl = first(find_all("content", DDL_TABLE))
    items = F.concat(
        locs(f.define, "write", "hive_table", ddl),
        locs(f.define & (F.size(ddl) > 0), "write", "hdfs_path", first(find_all("content", DDL_LOCATION))),
        locs(f.load, "write", "hive_table", find_all("content", INSERT_NAME)),
        locs(f.load | f.query, "read", "hive_table", find_all("content", FROM_NAME)),
        locs(f.pig, "read", "hdfs_path", find_all("content", PIG_LOAD)),
        locs(f.pig, "write", "hdfs_path", find_all("content", PIG_STORE)),
        locs(f.shell & f.writes_out, "write", "file", find_all("content", SHELL_TARGET)),
        locs(f.shell, "read", "hive_table", find_all("content", FROM_OR_JOIN_NAME)),
        locs(f.python, "read", F.when(f.text.contains("spark.read.table"), "table").otherwise("hdfs_path"),
             find_all("content", SPARK_READ)),
        locs(f.python, "write", F.when(f.text.contains("saveAsTable"), "table").otherwise("hdfs_path"),
             find_all("content", SPARK_WRITE)),
    )
    return explode_structs(files, F.array_distinct(items))


def transformation_kinds(files: DataFrame) -> DataFrame:
    """Transformation kinds a script uses, as an ordered array."""
    f = _Facts()
    flag = lambda cond, name: F.when(cond, name)
    sql = F.array_compact(F.array(
        flag(f.up.contains("WHERE") | f.up.contains("FILTER"), "filter"),
        flag(f.up.contains("JOIN"), "join"), flag(f.up.contains("GROUP BY"), "aggregate"),
        flag(f.up.contains("DISTINCT"), "distinct"),
        flag(f.up.contains("ORDER BY") | f.up.contains("SORT BY"), "sort")))
    by_pattern = lambda table: F.array_compact(F.array(*[flag(f.text.rlike(p), k) for k, p in table.items()]))
    kinds = (F.when(f.load, sql).when(f.pig, by_pattern(KIND_PATTERNS["pig"]))
             .when(f.python, by_pattern(KIND_PATTERNS["python"])).otherwise(F.array().cast(NO_STRINGS)))
    return files.withColumn("kinds", kinds).drop("content")


def file_references(files: DataFrame) -> DataFrame:
    """Edges script -> called script, distinct per script."""
    refs = F.array_distinct(find_many("content", vocab.FILE_REFERENCE_PATTERNS))
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.explode(refs).alias("reference"))


def sttm_from_ddl(scripts: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Target tables of a script times its typed columns, all or the first `max_columns`."""
    tables = F.array_distinct(F.concat(find_all("content", INSERT_NAME), find_all("content", DDL_TARGET)))
    columns = find_all("content", TYPED_COLUMN)
    if max_columns is not None:
        columns = F.slice(columns, 1, max_columns)
    pairs = F.flatten(F.transform(tables, lambda t: F.transform(columns, lambda c, i: F.struct(
        t.alias("target_table"), c.alias("target_column"), i.alias("processing_order")))))
    rows = explode_structs(scripts, pairs)
    return rows.withColumn("mapping_key", F.concat_ws("_", file_stem("path"), "target_table", "target_column",
                                                      F.col("processing_order").cast("string")))


def business_keywords(df: DataFrame, text="text", vocabulary=None) -> DataFrame:
    return df.withColumn("keywords", contained_words(text, vocabulary or vocab.BUSINESS_TERMS))


def assess_logic(df: DataFrame, code="content") -> DataFrame:
    """Purpose, quality rules and complexity of a snippet."""
    text, low = as_col(code), F.lower(as_col(code))
    has = lambda *ws: contains_any(low, ws)
    purpose = (
        F.when(has("customer"), "Customer data processing")
        .when(has("product"), "Product information management")
        .when(has("order"), "Order processing")
        .when(has("aggregate", "sum"), "Data aggregation and summarization")
        .when(has("join"), "Data enrichment through joins")
        .when(has("filter", "where"), "Data filtering and selection")
        .otherwise("Data transformation"))
    rules = F.array_compact(F.array(
        F.when(has("not null"), "NULL_CHECK"), F.when(has("distinct"), "DEDUPLICATION"),
        F.when(has("trim", "strip"), "WHITESPACE_TRIMMING"),
        F.when(has("upper", "lower"), "CASE_STANDARDIZATION"),
        F.when(has("cast", "convert"), "TYPE_CONVERSION")))
    lines = line_count(text)
    parens = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    nested = text.contains(")") & (parens > 2)
    kinds = sum((has(w).cast("int") for w in ["join", "filter", "group", "aggregate"]), F.lit(0))
    complexity = F.when((lines > 50) | nested | (kinds > 2), "HIGH").when(lines > 20, "MEDIUM").otherwise("LOW")
    return (df.withColumn("purpose", purpose).withColumn("quality_rules", rules)
            .withColumn("complexity", complexity))


def path_group(path, rule: str) -> Column:
    """Group key from a path: `top`, `first_two`, or `module` (folder after workflows/oozie)."""
    parts = F.filter(F.split(as_col(path), "/"), lambda p: p != "")
    n = F.size(parts)
    if rule == "top":
        return F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown"))
    if rule == "first_two":
        return F.when(n >= 2, F.concat_ws("/", F.slice(parts, 1, 2))) \
                .otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown")))
    follows = F.transform(parts, lambda p, i: F.when(
        p.isin("workflows", "oozie") & (i + 1 < n), F.get(parts, i + 1)))
    return F.coalesce(F.get(F.array_compact(follows), F.lit(0)), F.get(parts, n - 2), F.lit("unknown"))


def group_by_path(files: DataFrame, rule: str) -> DataFrame:
    return files.withColumn("path_group", path_group("path", rule))


def detect_projects(files: DataFrame, min_hits: int = 2) -> DataFrame:
    """Top folders with at least `min_hits` indicator subfolders."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = files.filter(F.size(parts) > 2).select(parts.getItem(0).alias("project"), parts.getItem(1).alias("sub"))
    skip = F.exists(words(vocab.PROJECT_SKIP_PREFIXES), lambda p: F.col("project").startswith(p))
    # at most one row per (project, indicator) after partial aggregation, however hot a project is
    return (rows.filter(~skip & F.col("sub").isin(*vocab.PROJECT_INDICATORS)).distinct()
            .groupBy("project").agg(F.count("*").alias("indicators"),
                                    F.array_sort(F.collect_set("sub")).alias("subfolders"))
            .filter(F.col("indicators") >= min_hits))


def usable(scripts: DataFrame, min_chars: int = 100) -> DataFrame:
    """Scripts with enough text and at least one read or write (arrays `reads`, `writes`)."""
    return scripts.filter((F.length(F.trim("content")) >= min_chars)
                          & (F.size("reads") + F.size("writes") > 0))


def filter_names(files: DataFrame, patterns, path="path") -> DataFrame:
    """Files whose name (without extension) contains one of the patterns, any case."""
    return files.filter(contains_any(F.lower(file_stem(path)), [p.lower() for p in patterns]))


def script_inventory(files: DataFrame, references: DataFrame) -> DataFrame:
    """Per repository and script type: files, lines, used and unused by any reference."""
    kind = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in vocab.SCRIPT_TYPES.items() for x in kv]),
        F.replace(extension("path"), F.lit("."), F.lit(""))), F.lit("Other"))
    skip = F.exists(words(vocab.SKIP_FOLDERS), lambda w: F.col("path").contains(w))
    rows = files.filter(~skip).select(
        path_group("path", "top").alias("repo"), kind.alias("script_type"), file_name("path").alias("name"),
        file_lines("content").alias("lines")).filter(F.col("script_type") != "Other")
    used = references.select(F.col("name")).distinct().withColumn("_used", F.lit(True))
    return (rows.join(used, "name", "left").groupBy("repo", "script_type")
            .agg(F.count("*").alias("files"), F.sum("lines").alias("lines"),
                 F.count_if(F.col("_used").isNotNull()).alias("used"),
                 F.count_if(F.col("_used").isNull()).alias("unused")))
