"""Facts from SQL text: table references, transformation rows, feed sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs, explode_values, group, matches
from estatelens.functions.text import find_all

# --- Fixed values: patterns on SQL text ---------------------------------------
FROM_TABLE = r"(?i)\bFROM\s+([a-zA-Z0-9_\.]+)"
JOIN_TABLE = r"(?i)\bJOIN\s+([a-zA-Z0-9_\.]+)"
INSERT_TABLE = r"(?i)\bINSERT\s+(?:INTO\s+|OVERWRITE\s+)?(?:TABLE\s+)?([a-zA-Z0-9_\.]+)"
CREATE_TABLE = r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([a-zA-Z0-9_\.]+)"
WHERE_CLAUSE = r"(?is)WHERE\s+(.+?)(?:GROUP\s+BY|ORDER\s+BY|LIMIT|;|\n\n)"
JOIN_CLAUSE = (r"(?is)((?:LEFT|RIGHT|INNER|FULL)?\s*(?:OUTER\s+)?JOIN)\s+([a-zA-Z0-9_\.]+)"
               r"\s+(?:ON|USING)\s+(.+?)(?:WHERE|JOIN|GROUP|ORDER|;)")
GROUP_CLAUSE = r"(?is)GROUP\s+BY\s+([^H]+?)(?:HAVING|ORDER|LIMIT|;)"
AGGREGATE_CALL = r"(?i)(COUNT|SUM|AVG|MAX|MIN|COLLECT_LIST|COLLECT_SET)\s*\("


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sql_reads(content="content") -> Column:
    reserved = [F.lit(w) for w in vocab.FROM_RESERVED]
    names = F.filter(find_all(content, FROM_TABLE), lambda t: ~F.upper(t).isin(*reserved))
    return F.array_distinct(F.concat(names, find_all(content, JOIN_TABLE)))


def sql_writes(content="content") -> Column:
    return F.array_distinct(F.concat(find_all(content, INSERT_TABLE), find_all(content, CREATE_TABLE)))


def sql_table_refs(scripts: DataFrame) -> DataFrame:
    """One row (kind = read | write, value = table) per distinct table of a script."""
    return explode_values(scripts, read=sql_reads(), write=sql_writes())


def _step(kind, snippet, condition=None, join_type=None, table=None, columns=None, function=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        snippet.alias("snippet"),
        (none if condition is None else condition).alias("condition"),
        (none if join_type is None else join_type).alias("join_type"),
        (none if table is None else table).alias("table_name"),
        (F.array().cast("array<string>") if columns is None else columns).alias("columns"),
        (none if function is None else function).alias("function_name"),
    )


def sql_steps(content="content", max_chars: int | None = None) -> Column:
    """Array of transformation structs: filters, joins, groupings, aggregate calls; texts of joins whole or cut."""
    def where(m):
        c = strip(group(m, WHERE_CLAUSE, 1))
        return _step("filter", F.concat(F.lit("WHERE "), c), condition=c)

    def join(m):
        return _step("join", m if max_chars is None else F.left(m, F.lit(max_chars)), condition=strip(group(m, JOIN_CLAUSE, 3)),
                     join_type=F.upper(strip(group(m, JOIN_CLAUSE, 1))), table=group(m, JOIN_CLAUSE, 2))

    def by(m):
        c = strip(group(m, GROUP_CLAUSE, 1))
        return _step("group_by", F.concat(F.lit("GROUP BY "), c),
                     columns=F.transform(F.split(c, ","), strip))

    def call(m):
        f = F.upper(group(m, AGGREGATE_CALL, 1))
        return _step("aggregate", F.concat(f, F.lit("(...)")), function=f)

    return F.concat(
        F.transform(matches(content, WHERE_CLAUSE), where),
        F.transform(matches(content, JOIN_CLAUSE), join),
        F.transform(matches(content, GROUP_CLAUSE), by),
        F.transform(matches(content, AGGREGATE_CALL), call),
    )


def sql_transformations(scripts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row per filter, join, grouping and aggregate call, numbered within the script."""
    return explode_structs(scripts, sql_steps(max_chars=max_chars), ordinal="step_no")


def feed_sections(scripts: DataFrame) -> DataFrame:
    """Feed facts of SQL code: join rows, WHERE conjuncts and feed flags."""
    def row(section, a, b, c):
        return F.struct(F.lit(section).alias("section"), a.alias("name"), b.alias("detail"), c.alias("value"))

    up = F.upper(F.col("content"))
    yes_no = lambda cond: F.when(cond, "Yes").otherwise("No")
    conjuncts = F.flatten(F.transform(
        matches("content", WHERE_CLAUSE),
        lambda m: F.split(strip(group(m, WHERE_CLAUSE, 1)), r"(?i)\sAND\s")))
    none = F.lit("")
    items = F.concat(
        F.array(
            row("flag", F.lit("COMBINE FILES"), none, yes_no(up.rlike(r"\bUNION\b"))),
            row("flag", F.lit("MULTIPLE FILES"), none, yes_no(F.size(sql_reads()) > 1)),
            row("flag", F.lit("ADDITIONAL RECORDS"), none, yes_no(up.rlike(r"\b(INSERT|UPDATE)\b"))),
        ),
        F.transform(conjuncts, lambda c: row("validation", F.lit("WHERE"), none, strip(c))),
        F.transform(matches("content", JOIN_CLAUSE),
                    lambda m: row("join", F.upper(strip(group(m, JOIN_CLAUSE, 1))),
                                  group(m, JOIN_CLAUSE, 2), strip(group(m, JOIN_CLAUSE, 3)))),
    )
    return explode_structs(scripts, items)
