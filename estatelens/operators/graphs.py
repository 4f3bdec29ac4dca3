"""Facts from graph blocks, graph components and spreadsheet-style summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs, group, matches
from estatelens.functions.scale import forward_fill
from estatelens.functions.text import find_all, words

# --- Fixed values: patterns on graph blocks ------------------------------------------
PARAMETER_SET = r"(?s)XXparameter_set\|@@@@\{\{(.*?)\}\}@"
PARAMETER = r"\{(\d+)\|XXparameter\|!?([^|]+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^}]*)\}"
BLOCK_ID = r"\{(\d+)\|"
CONNECTION = r"\{(\d+)\}.*?-+>.*?\{(\d+)\}"
DML_FIELD = r"(\w+)\s+\w+\([^)]+\)"
SUMMARY_ITEM = r"^(\d+_[A-Z]+)\s+(\w+)\s*-\s*([^\-]+)\s*-\s*(.+)"


def block_parameters(blocks: DataFrame) -> DataFrame:
    """Clean parameter name and value per block; internal `_ab_` parameters are left out."""
    found = F.flatten(F.transform(find_all("block_text", PARAMETER_SET), lambda s: F.transform(
        matches(s, PARAMETER), lambda m: F.struct(F.trim(group(m, PARAMETER, 2)).alias("name"),
                                                  F.trim(group(m, PARAMETER, 3)).alias("value")))))
    return explode_structs(blocks, F.filter(found, lambda p: ~p["name"].startswith("_ab_")), drop=("block_text",))


def block_components(blocks: DataFrame) -> DataFrame:
    """Component id, type and name of blocks that name a known component type."""
    kinds = F.filter(words(vocab.GRAPH_COMPONENT_TYPES), lambda t: F.col("block_text").contains(t))
    rows = blocks.withColumn("component_type", F.get(kinds, F.lit(0))).filter(F.col("component_type").isNotNull()) \
        .withColumn("component_id", F.regexp_extract("block_text", BLOCK_ID, 1)).filter(F.col("component_id") != "")
    # the header of a block is `{id|type|name|`
    parts = F.split(F.regexp_extract("block_text", r"(\{\d+\|[^|]+\|[^|]+\|)", 1), r"\|")
    name = F.when(F.get(parts, F.lit(1)) == F.col("component_type"), F.trim(F.get(parts, F.lit(2))))
    return rows.withColumn("component_name", F.coalesce(name, F.concat_ws("_", "component_type", "component_id"))) \
        .drop("block_text")


def block_edges(blocks: DataFrame) -> DataFrame:
    """Edges between component names; ids without a named component become `component_<id>`."""
    edges = explode_structs(blocks.select("graph", "block_text"), F.transform(
        matches("block_text", CONNECTION), lambda m: F.struct(
            group(m, CONNECTION, 1).alias("source_id"), group(m, CONNECTION, 2).alias("target_id"))), drop=("block_text",))
    named = block_components(blocks).filter(F.col("component_name") != F.concat_ws("_", "component_type", "component_id"))
    names = named.groupBy("graph", "component_id").agg(F.max("component_name").alias("component_name"))
    for side in ("source", "target"):
        lookup = names.select("graph", F.col("component_id").alias(f"{side}_id"), F.col("component_name").alias(f"{side}_name"))
        edges = edges.join(lookup, ["graph", f"{side}_id"], "left").withColumn(
            f"{side}_name", F.coalesce(f"{side}_name", F.concat(F.lit("component_"), f"{side}_id")))
    return edges


def component_transformations(components: DataFrame) -> DataFrame:
    """Transformation rows by component type from the parameter map `params`."""
    kind = F.lower("component_type")
    p = lambda *names: F.coalesce(*[F.try_element_at("params", F.lit(n)) for n in names], F.lit(""))
    row = lambda k, snippet, cond: F.struct(F.lit(k).alias("kind"), snippet.alias("snippet"), cond.alias("condition"))
    none = F.lit(None).cast("string")
    entries = F.filter(F.map_entries("params"), lambda e: F.lower(e["key"]).contains("expr") | F.lower(e["key"]).contains("formula"))
    transform = F.transform(F.array_sort(entries), lambda e: row("transform", F.concat_ws(" = ", e["key"], e["value"]), none))
    cond = p("filter_expr", "condition")
    filter_ = F.filter(F.array(row("filter", F.concat(F.lit("FILTER: "), cond), cond)), lambda r: cond != "")
    key = p("join_key", "key")
    join = F.array(row("join", F.concat(F.lit("JOIN ON "), key, F.lit(" ("), F.coalesce(
        F.try_element_at("params", F.lit("join_type")), F.lit("inner")), F.lit(")")), F.concat(F.lit("key="), key)))
    by = p("group_by", "key")
    agg = F.array(row("aggregate", F.concat(F.lit("GROUP BY "), by, F.lit(" AGGREGATE "), p("aggregate", "expression")),
                      F.concat(F.lit("group_by="), by)))
    sort = F.array(row("sort", F.concat(F.lit("SORT BY "), p("sort_key", "key")), none))
    items = (F.when(kind.contains("transform") | kind.contains("reformat"), transform)
             .when(kind.contains("filter"), filter_).when(kind.contains("join"), join)
             .when(kind.contains("aggregate") | kind.contains("rollup"), agg).when(kind.contains("sort"), sort))
    return explode_structs(components, items, drop=("params", "dml"))


def dml_fields(components: DataFrame) -> DataFrame:
    """Identity lineage rows of the record fields `name type(...)`.

    The record text is the parameter dml, layout or record_format, else the column `dml`.
    """
    p = [F.nullif(F.try_element_at("params", F.lit(n)), F.lit("")) for n in ("dml", "layout", "record_format")]
    text = F.coalesce(*p, F.col("dml"), F.lit(""))
    keep = [c for c in components.columns if c not in ("params", "dml")]
    rows = components.select(*keep, F.posexplode(find_all(text, DML_FIELD)).alias("field_no", "field"))
    return rows.select("component_id", "field_no", F.col("name").alias("source_table"), F.col("field").alias("source_column"),
                       F.col("name").alias("target_table"), F.col("field").alias("target_column"))


def parse_summary_rows(rows: DataFrame, span: int = 100_000) -> DataFrame:
    """Input and output items of graphs from key/value rows of a sheet.

    `rows` has (sheet, row_no, key, value). The graph name and the section carry forward to
    the rows below them; a new graph keeps the section that was open.
    """
    low = F.lower(F.trim("key"))
    is_graph = low.contains("graph") & low.contains("name")
    graph = F.when(is_graph, F.trim("value"))
    in_graph = F.col("graph").isNotNull()
    tagged = rows.withColumn("graph", graph).withColumn("is_graph", is_graph) \
        .withColumn("is_summary", ~is_graph & low.contains("summary"))
    tagged = forward_fill(tagged, ["sheet"], "row_no", ["graph"], span)
    section = F.when(in_graph & ~F.col("is_graph") & ~F.col("is_summary"),
                     F.when(low.contains("input"), "inputs").when(low.contains("output"), "outputs"))
    tagged = tagged.withColumn("opens", section).withColumn("section", F.col("opens"))
    tagged = forward_fill(tagged, ["sheet"], "row_no", ["section"], span)
    items = tagged.filter(in_graph & ~F.col("is_graph") & ~F.col("is_summary") & F.col("opens").isNull()
                          & F.col("section").isNotNull() & (F.col("value") != ""))
    full = F.col("value").rlike(SUMMARY_ITEM)
    part = lambda i: F.trim(F.regexp_extract("value", SUMMARY_ITEM, i))
    pieces = F.split("value", "-")
    head = F.split(F.trim(pieces.getItem(0)), r"\s+")
    piece = lambda i: F.coalesce(F.trim(F.get(pieces, F.lit(i))), F.lit(""))
    out = items.filter(full | ((F.size(pieces) >= 2) & (F.size(head) >= 2)))
    pick = lambda a, b: F.when(full, a).otherwise(b)
    return out.select("sheet", "row_no", "graph", "section",
                      pick(part(1), head.getItem(0)).alias("component_id"), pick(part(2), head.getItem(1)).alias("component_name"),
                      pick(part(3), piece(1)).alias("file_path"), pick(part(4), piece(2)).alias("description"))


def graph_summaries(rows: DataFrame, span: int = 100_000) -> DataFrame:
    """Summary text per graph: the last one below its name."""
    low = F.lower(F.trim("key"))
    is_graph = low.contains("graph") & low.contains("name")
    tagged = rows.withColumn("graph", F.when(is_graph, F.trim("value"))).withColumn(
        "summary", F.when(~is_graph & low.contains("summary"), F.trim("value")))
    filled = forward_fill(tagged, ["sheet"], "row_no", ["graph"], span).filter("graph IS NOT NULL")
    return filled.groupBy("sheet", "graph").agg(
        F.coalesce(F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("row_no"))), F.lit("")).alias("summary"))
