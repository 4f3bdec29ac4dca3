"""Scalar column functions on names, paths, types and script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions import vocab

NEWLINE = "\n"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def find_all(text, pattern: str, group: int = 1) -> Column:
    """All values of one capture group, in order of occurrence."""
    return F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(group))


def find_many(text, patterns, group: int = 1) -> Column:
    """Values of several patterns, pattern after pattern."""
    return F.flatten(F.array(*[find_all(text, p, group) for p in patterns]))


def contains_any(text, values) -> Column:
    """True when the text contains one of the literal values (case as given)."""
    text = as_col(text)
    out = F.lit(False)
    for v in values:
        out = out | text.contains(v)
    return out


def contained_words(text, values) -> Column:
    """The vocabulary words that occur in the lower-cased text, sorted.

    One literal test per word compiles, and the lower-cased text is shared between them.
    """
    low = F.lower(as_col(text))
    return F.array_compact(F.array(*[F.when(low.contains(w), w) for w in sorted(values)]))


def lookup(key, table: dict, default: str) -> Column:
    """Value of a small fixed lookup table, else the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(key)), F.lit(default))


def normal_name(name) -> Column:
    """Lower case without underscore, hyphen and space."""
    return F.regexp_replace(F.lower(as_col(name)), r"[_\- ]", "")


def clean_table(name) -> Column:
    """Text after the last slash and before the first dot, lower case."""
    last = F.element_at(F.split(as_col(name), "/"), -1)
    return F.lower(F.split(last, r"\.").getItem(0))


def short_id(*parts, size: int = 16) -> Column:
    """First hex digits of the md5 of the parts joined by underscore."""
    return F.left(F.md5(F.concat_ws("_", *[as_col(p) for p in parts])), F.lit(size))


def graph_datatype(raw) -> Column:
    return lookup(F.lower(as_col(raw)), vocab.GRAPH_DATATYPES, "unknown")


def hive_datatype(raw) -> Column:
    return lookup(F.lower(as_col(raw)), vocab.HIVE_DATATYPES, "unknown")


def action_component_type(action) -> Column:
    return lookup(F.lower(as_col(action)), vocab.ACTION_TO_COMPONENT, "Unknown")


def graph_component_type(kind) -> Column:
    return lookup(kind, vocab.GRAPH_TO_COMPONENT, "Unknown")


def graph_action_type(kind) -> Column:
    return lookup(kind, vocab.GRAPH_TO_ACTION, "script")


def normal_transformation(name) -> Column:
    """Common name of a transformation kind."""
    low = F.lower(as_col(name))
    has = lambda *ws: contains_any(low, ws)
    return (
        F.when(has("filter", "where"), "filter")
        .when(has("join"), "join")
        .when(has("group", "aggregate", "agg"), "group")
        .when(has("distinct", "duplicate", "dedup"), "distinct")
        .when(has("sort", "order"), "sort")
        .when(has("union"), "union")
        .otherwise(low)
    )


def newlines(text) -> Column:
    text = as_col(text)
    return F.length(text) - F.length(F.replace(text, F.lit(NEWLINE), F.lit("")))


def line_count(text) -> Column:
    return newlines(text) + 1


def file_lines(text) -> Column:
    """Lines as a reader of the file counts them: a last line break opens no new line."""
    text = as_col(text)
    return newlines(text) + F.when((text == "") | text.endswith(NEWLINE), 0).otherwise(1)


def file_name(path) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def parent_folder(path) -> Column:
    return F.coalesce(F.try_element_at(F.split(as_col(path), "/"), F.lit(-2)), F.lit(""))


def transformation_rule(rules, summary) -> Column:
    """Rules `type: expression` (or the description) joined by `; `, else the summary."""
    text = F.array_join(
        F.transform(
            as_col(rules),
            lambda r: F.when(
                F.coalesce(r["expression"], F.lit("")) != "",
                F.concat(r["rule_type"], F.lit(": "), r["expression"]),
            ).otherwise(r["description"]),
        ),
        "; ",
    )
    return F.coalesce(
        F.nullif(text, F.lit("")), F.nullif(as_col(summary), F.lit("")), F.lit("Direct mapping")
    )


def line_for_column(logic, column, has_source) -> Column:
    """First line of the logic that names the column (at most 200 characters)."""
    logic, column = as_col(logic), as_col(column)
    hit = F.get(F.filter(F.split(logic, NEWLINE), lambda l: l.contains(column)), F.lit(0))
    return (
        F.when(F.coalesce(logic, F.lit("")) == "",
               F.when(has_source, "Direct mapping").otherwise("Derived column"))
        .otherwise(F.left(F.coalesce(F.trim(hit), logic), F.lit(200)))
    )


def workflow_name(xml_name, path, strip_prefix: str = "") -> Column:
    """Name attribute without the prefix and edge marks; else the file or folder name."""
    cleaned = F.trim(F.replace(as_col(xml_name), F.lit(":"), F.lit("")))
    if strip_prefix:
        cleaned = F.trim(F.replace(cleaned, F.lit(strip_prefix), F.lit("")))
    cleaned = F.regexp_replace(cleaned, r"^[\s:_-]+|[\s:_-]+$", "")
    stem, folder = file_stem(path), parent_folder(path)
    fallback = F.when((stem == "workflow") & (folder != "oozie"), folder).otherwise(stem)
    return F.coalesce(F.nullif(cleaned, F.lit("")), fallback)


def amount_text(x) -> Column:
    """Whole numbers without decimals, others with one."""
    whole = x % 1 == 0
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", x))


def effort_text(hours, days) -> Column:
    h, d = amount_text(as_col(hours)), amount_text(as_col(days))
    return (
        F.when(as_col(days) < 1, F.concat(h, F.lit(" hours")))
        .when(as_col(days) < 2, F.concat(d, F.lit(" day ("), h, F.lit(" hours)")))
        .otherwise(F.concat(d, F.lit(" days ("), h, F.lit(" hours)")))
    )
