"""Facts from Pig text: reads and writes, variables, transformation rows, column lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs, explode_values, group, matches, matches_with_lines
from estatelens.functions.text import as_col, find_all, words
from estatelens.operators.sql_scripts import strip

# --- Fixed values: patterns on Pig text ---------------------------------------
LOAD = r"""(?i)LOAD\s+['"]([^'"]+)['"]"""
STORE = r"""(?i)STORE\s+\w+\s+INTO\s+['"]([^'"]+)['"]"""
HCAT_LOAD = r"""HCatLoader\(\s*['"]([^'"]+)['"]"""
HCAT_STORE = r"""HCatStorer\(\s*['"]([^'"]+)['"]"""
SET = r"(?i)SET\s+(\S+)\s+(.+);"
DEFINE = r"(?i)DEFINE\s+(\w+)\s+(.+);"
STATEMENTS = {
    "filter": r"(?i)(\w+)\s*=\s*FILTER\s+(\w+)\s+BY\s+(.+?);",
    "join": r"(?is)(\w+)\s*=\s*JOIN\s+(.+?)\s+BY\s+(.+?);",
    "group": r"(?i)(\w+)\s*=\s*GROUP\s+(\w+)\s+BY\s+(.+?);",
    "foreach": r"(?is)(\w+)\s*=\s*FOREACH\s+(\w+)\s+GENERATE\s+(.+?);",
    "distinct": r"(?i)(\w+)\s*=\s*DISTINCT\s+(\w+);",
    "order": r"(?i)(\w+)\s*=\s*ORDER\s+(\w+)\s+BY\s+(.+?);",
    "union": r"(?i)(\w+)\s*=\s*UNION\s+(.+?);",
}
IDENTIFIER = r"\b([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)\b"
CALL = r"(\w+)\s*\("
COLUMN_REF = r"(?:^|[\s\(])([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)?)"
CALC_MARKS = ["+", "-", "*", "/", "(", "CASE", "IF"]


def pig_io(scripts: DataFrame) -> DataFrame:
    """Rows (kind, value): files and catalog tables read and written."""
    return explode_values(
        scripts,
        read_file=find_all("content", LOAD), write_file=find_all("content", STORE),
        read_table=find_all("content", HCAT_LOAD), write_table=find_all("content", HCAT_STORE),
    )


def pig_variables(scripts: DataFrame) -> DataFrame:
    """SET and DEFINE entries; the last value of a name wins; a `(` marks a user function."""
    def entry(m, pattern, prefix, is_define):
        value = strip(group(m, pattern, 2))
        if not is_define:
            value = F.regexp_replace(value, r"""^['"]+|['"]+$""", "")
        return F.struct(
            F.concat(F.lit(prefix), group(m, pattern, 1)).alias("name"), value.alias("value"),
            (value.contains("(") if is_define else F.lit(False)).alias("is_function"))

    items = F.concat(
        F.transform(matches("content", SET), lambda m: entry(m, SET, "", False)),
        F.transform(matches("content", DEFINE), lambda m: entry(m, DEFINE, "DEFINE_", True)),
    )
    last = F.filter(items, lambda x, i: ~F.exists(
        F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: y["name"] == x["name"]))
    return explode_structs(scripts, last)


def join_class(text) -> Column:
    up = F.upper(as_col(text))
    return (F.when(up.contains("LEFT"), "LEFT OUTER JOIN")
            .when(up.contains("FULL OUTER"), "FULL OUTER JOIN").otherwise("INNER JOIN"))


def join_keys(keys) -> Column:
    """Keys split at commas, relation prefix before `::` removed."""
    return F.transform(F.split(as_col(keys), ","), lambda x: strip(F.element_at(F.split(x, "::"), -1)))


def classify_join(df: DataFrame, statement="statement", keys="keys") -> DataFrame:
    return df.withColumn("join_type", join_class(statement)).withColumn("join_keys", join_keys(keys))


def predicate_identifiers(condition) -> Column:
    """Distinct identifiers of a condition without the logical words, sorted."""
    drop = [F.lit(w) for w in vocab.PREDICATE_WORDS]
    names = F.filter(find_all(condition, IDENTIFIER), lambda n: ~F.upper(n).isin(*drop))
    return F.array_sort(F.array_distinct(names))


def predicate_columns(df: DataFrame, condition="condition") -> DataFrame:
    return df.withColumn("columns", predicate_identifiers(condition))


def projection_functions(projections) -> Column:
    """Distinct upper-case function names called in a projection list, sorted."""
    names = F.transform(find_all(projections, CALL), lambda f: F.upper(f))
    return F.array_sort(F.array_distinct(F.filter(names, lambda f: f != "AS")))


def projection_columns(projections) -> Column:
    """Column references; names of functions already seen and AS/AND/OR are left out."""
    parts = F.transform(F.split(as_col(projections), ","), strip)
    calls = F.transform(parts, lambda p: F.filter(
        F.transform(find_all(p, CALL), lambda f: F.upper(f)), lambda f: f != "AS"))
    cols = F.transform(parts, lambda p, i: F.filter(
        find_all(p, COLUMN_REF),
        lambda c: ~F.array_contains(F.flatten(F.slice(calls, F.lit(1), i + 1)), F.upper(c))
        & ~F.upper(c).isin("AS", "AND", "OR")))
    return F.array_sort(F.array_distinct(F.flatten(cols)))


def has_aggregate(projections) -> Column:
    up = F.upper(as_col(projections))
    return F.exists(words(vocab.AGGREGATE_WORDS), lambda w: up.contains(w))


def projection_parts(df: DataFrame, projections="projections") -> DataFrame:
    return (df.withColumn("columns", projection_columns(projections))
            .withColumn("functions", projection_functions(projections))
            .withColumn("is_aggregate", has_aggregate(projections)))


def _steps(kind: str) -> Column:
    pattern = STATEMENTS[kind]

    def step(m, i):
        text = m["text"]
        body = strip(group(text, pattern, 3)) if kind not in ("distinct", "union") else F.lit("")
        none, no_cols = F.lit(None).cast("string"), F.array().cast("array<string>")
        columns, type_, join_type = no_cols, F.lit(kind), none
        if kind == "filter":
            columns = predicate_identifiers(body)
        elif kind == "join":
            join_type = F.when(F.upper(text).contains("LEFT OUTER") | F.upper(group(text, pattern, 2)).contains("LEFT"),
                               "LEFT OUTER JOIN").when(F.upper(text).contains("FULL OUTER"), "FULL OUTER JOIN") \
                         .otherwise("INNER JOIN")
            columns = join_keys(body)
        elif kind in ("group", "order"):
            columns = F.transform(F.split(body, ","), strip)
        elif kind == "foreach":
            columns = projection_columns(body)
            type_ = F.when(has_aggregate(body), "aggregate").otherwise("transform")
        return F.struct(
            type_.alias("step_type"), F.concat(F.lit(f"{kind}_"), (i + 1).cast("string")).alias("step_id"),
            m["line"].alias("line_no"), text.alias("snippet"),
            (body if kind == "filter" else none).alias("condition"),
            join_type.alias("join_type"), columns.alias("columns"))

    return F.transform(matches_with_lines("content", pattern), step)


def pig_transformations(scripts: DataFrame) -> DataFrame:
    """One row per Pig statement with ordinal id and line number; one scan of the text."""
    return explode_structs(scripts, F.concat(*[_steps(k) for k in STATEMENTS]))


def column_lineage(scripts: DataFrame) -> DataFrame:
    """Target columns of FOREACH: pass-through, calculated or aggregated."""
    pattern = STATEMENTS["foreach"]

    def parts(m):
        return F.transform(F.split(strip(group(m, pattern, 3)), ","), lambda p: F.struct(
            group(m, pattern, 2).alias("source_table"), group(m, pattern, 1).alias("target_table"),
            strip(p).alias("projection")))

    rows = explode_structs(scripts, F.flatten(F.transform(matches("content", pattern), parts)))
    pieces = F.split("projection", r"(?i)\s+AS\s+")
    named = F.upper("projection").contains(" AS ")
    rows = (rows.withColumn("expression", F.when(named, F.trim(pieces.getItem(0))).otherwise(F.col("projection")))
            .withColumn("target_column", F.when(named, F.trim(pieces.getItem(1))).otherwise(F.col("projection"))))
    expr = F.col("expression")
    kind = (F.when(expr.contains(".") & ~expr.contains("("), "pass_through")
            .when(F.exists(words(CALC_MARKS), lambda w: expr.contains(w)), "calculated")
            .when(has_aggregate(expr), "aggregated"))
    return (rows.withColumn("lineage_kind", kind).filter(F.col("lineage_kind").isNotNull())
            .withColumn("source_column", F.when(F.col("lineage_kind") == "pass_through",
                                                F.element_at(F.split(expr, r"\."), -1))
                        .otherwise(F.col("lineage_kind")))
            .drop("projection"))


def rule_flags(content="content") -> Column:
    """Names of the rules a script shows, in a fixed order."""
    text = as_col(content)
    up = F.upper(text)
    joins = F.size(F.split(up, "JOIN")) - 1
    flag = lambda cond, name: F.when(cond, name)
    return F.array_compact(F.array(
        flag(up.contains("IS NOT NULL"), "null_check"),
        flag(up.contains("ISEMPTY") | up.contains("IS NULL"), "empty_check"),
        flag(up.contains("AGE") & (text.contains("> 18") | text.contains(">= 18")), "adult_filter"),
        flag(up.contains("STATUS") & up.contains("ACTIVE"), "active_filter"),
        flag(up.contains("DATE") & (up.contains("CURRENT") | up.contains("TODAY")), "current_date"),
        flag(up.contains("DISTINCT"), "deduplication"),
        flag(joins > 3, "many_joins"),
        flag(up.contains("GROUP BY") & up.contains("ALL"), "group_all"),
    ))


def script_flags(scripts: DataFrame) -> DataFrame:
    return scripts.select(*[c for c in scripts.columns if c != "content"], rule_flags().alias("flags"))
