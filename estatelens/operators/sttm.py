"""Source-to-target mappings of columns: per component, across processes, as a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.matches import explode_structs
from estatelens.functions.scale import cut_lineage, join_spread, maybe_broadcast, number_rows
from estatelens.functions.text import as_col, hive_datatype, line_for_column, short_id

# --- Fixed values: columns of the report --------------------------------------
REPORT_COLUMNS = [
    "STTM_ID", "Process_Name", "System", "Business_Domain",
    "Source_Table", "Source_Column", "Source_Datatype", "Source_Description",
    "Source_Is_PK", "Source_Is_Nullable",
    "Target_Table", "Target_Column", "Target_Datatype", "Target_Description",
    "Target_Is_PK", "Target_Is_Nullable",
    "Processing_Order", "Transformation_Rule", "Business_Rule", "Data_Quality_Rule",
    "Mapping_Type", "Mapping_Confidence", "Notes", "Tags",
]


def _mapping(key, source_column, source_type, target_column, target_type, kind, rule,
             order=None, source_table=None, target_table=None) -> Column:
    text = lambda c: (F.lit("") if c is None else c).cast("string")
    return F.struct(
        text(key).alias("mapping_key"), text(source_table).alias("source_table"),
        text(source_column).alias("source_column"), text(source_type).alias("source_type"),
        text(target_table).alias("target_table"), text(target_column).alias("target_column"),
        text(target_type).alias("target_type"), text(kind).alias("mapping_type"), text(rule).alias("rule"),
        (F.lit(0) if order is None else order).cast("int").alias("processing_order"))


def first_by_name(fields, name: Column) -> Column:
    """First field whose name equals the given one in any case, else null."""
    return F.get(F.filter(as_col(fields), lambda f: F.lower(f["name"]) == F.lower(name)), F.lit(0))


def schema_mapping(out="out", hit="hit", logic="logic") -> Column:
    """An output field with the first input field of that name; none means derived."""
    out, hit = as_col(out), as_col(hit)
    found = hit.isNotNull()
    return _mapping(out["name"], F.coalesce(hit["name"], F.lit("")), F.coalesce(hit["type"], F.lit("")),
                    out["name"], out["type"], F.when(found, "direct").otherwise("derived"),
                    line_for_column(logic, out["name"], found))


def output_mapping(out="out", at="at", table="output_dataset") -> Column:
    """A field, and its place from 0, of a component that only defines its output."""
    out, at = as_col(out), as_col(at)
    return _mapping(
        F.concat(F.lit("field_"), at.cast("string")), None, None, out["name"], hive_datatype(out["type"]),
        F.lit("output_definition"), None, order=at + 1, target_table=as_col(table))


def whole_component_mapping(source="input_dataset", target="output_dataset", logic="logic") -> Column:
    """`*` to `*` when no schema is known but a dataset is."""
    rule = F.coalesce(F.nullif(as_col(logic), F.lit("")), F.lit("Component transformation"))
    return _mapping(F.lit("basic"), F.lit("*"), None, F.lit("*"), None, F.lit("component_level"), rule,
                    source_table=as_col(source), target_table=as_col(target))


def component_mappings(components: DataFrame) -> DataFrame:
    """All mappings of components in one pass over the rows, no shuffle.

    Columns used: component_id, in_fields, out_fields (arrays of name and type), logic,
    input_dataset, output_dataset. Fields become rows first, so each is looked up once.
    """
    used = ("in_fields", "out_fields", "logic", "input_dataset", "output_dataset")
    has_in, has_out = F.size("in_fields") > 0, F.size("out_fields") > 0
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = F.when(has_in & has_out, "schema").when(has_out, "output") \
        .when(~has_in & (some("input_dataset") | some("output_dataset")), "whole")
    none = F.lit(None).cast(components.schema["out_fields"].dataType.elementType)
    rows = components.withColumn("kind_", kind)
    rows = rows.select(*rows.columns, F.posexplode(
        F.when(F.col("kind_") == "whole", F.array(none)).when(F.col("kind_").isNotNull(), F.col("out_fields"))).alias("at_", "out_"))
    rows = rows.withColumn("hit_", F.when(F.col("kind_") == "schema", first_by_name("in_fields", F.col("out_")["name"])))
    item = F.when(F.col("kind_") == "schema", schema_mapping("out_", "hit_")) \
        .when(F.col("kind_") == "output", output_mapping("out_", "at_")).otherwise(whole_component_mapping())
    keep = [c for c in components.columns if c not in used]
    rows = rows.select(*keep, item.alias("item_")).select(*keep, "item_.*")
    return rows.withColumn("mapping_id", short_id("component_id", "mapping_key")).drop("mapping_key")


def _with_fields(components: DataFrame, datasets: str, fields: Column) -> DataFrame:
    rows = components.select("component_id", "process_id", F.array_sort(F.array_distinct(datasets)).alias("sets"),
                             fields.alias("fields"))
    return rows.filter(F.size("fields") > 0)


def _sides(pairs: DataFrame, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the matched processes with the datasets and fields that count."""
    known = lambda side: maybe_broadcast(cut_lineage(pairs.select(F.col(f"{side}_process").alias("process_id")).distinct()), PAIRS_AT_ONCE)
    of = lambda df, side: df.join(known(side), "process_id", "left_semi")
    read = F.when(F.size("in_fields") > 0, F.col("in_fields")).otherwise(F.col("out_fields"))
    return (_with_fields(of(source, "source"), "outputs", F.col("out_fields")),
            _with_fields(of(target, "target"), "inputs", read))


PAIRS_AT_ONCE = 1_000_000  # pairs of processes that a task may hold
PAIR_BLOCK = 1024  # source components of a dataset and process that are paired in one task
CLASS = ["process_id", "sets", "fields"]  # components that agree in these connect and map alike


def _classes(rows: DataFrame) -> DataFrame:
    """Numbered classes. Files of repeated fields are many times smaller than their rows, so a plan that goes by
    the size of files would send all classes through the driver: the hint keeps joins with them on shuffles."""
    counted = rows.groupBy(*CLASS).agg(F.count("*").alias("n"))
    return cut_lineage(counted.withColumn("class", F.monotonically_increasing_id())).hint("merge")


def cross_process_classes(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Field mappings between classes of connected components of matched processes.

    Components connect when an output dataset of one is an input dataset of the other. They
    are first grouped into classes with the same process, datasets and fields, so a dataset
    shared by very many components joins a few classes; `n_pairs` tells how many component
    pairs a row stands for.
    """
    return _class_mappings(pairs, *(_classes(side) for side in _sides(pairs, source, target)))


def _class_mappings(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("class", "process_id", "fields", "n")])
    outs = left.select(F.col("class").alias("source_class"), F.col("process_id").alias("source_process"),
                       F.explode("sets").alias("dataset")).join(pairs, "source_process")
    ins = right.select(F.col("class").alias("target_class"), F.col("process_id").alias("target_process"),
                       F.explode("sets").alias("dataset"))
    links = outs.join(ins, ["target_process", "dataset"]).select("source_class", "target_class").distinct()
    rows = links.join(named(left, "source"), "source_class").join(named(right, "target"), "target_class")

    return _field_mappings(rows).withColumn("n_pairs", F.col("source_n") * F.col("target_n")).drop("source_n", "target_n") \
        .withColumnsRenamed({"source_process_id": "source_process", "target_process_id": "target_process"})


def _field_mappings(rows: DataFrame) -> DataFrame:
    """One row per target field, with the first source field of its name."""
    def one(t):
        hit = first_by_name("source_fields", t["name"])
        return F.struct(F.coalesce(hit["name"], F.lit("")).alias("source_column"),
                        F.coalesce(hit["type"], F.lit("")).alias("source_type"),
                        t["name"].alias("target_column"), t["type"].alias("target_type"),
                        hit.isNull().alias("is_derived"))

    return explode_structs(rows, F.transform("target_fields", one), drop=("source_fields", "target_fields")) \
        .withColumn("mapping_type", F.lit("cross_system"))


def cross_process_mappings(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The mappings listed per component pair, with mapping ids.

    The list is as long as the number of connected pairs; `cross_process_classes` is not. Components of either side move once,
    to where their process and dataset meet (`join_spread`); pairs are listed there and do not move. A pair that
    shares several datasets is met at the least of them.
    """
    pairs = cut_lineage(pairs.select("source_process", "target_process").distinct())
    left, right = _sides(pairs, source, target)
    of = lambda rows, side: rows.select(F.col("process_id").alias(f"{side}_process"), F.explode("sets").alias("dataset"),
                                        F.col("component_id").alias(f"{side}_component"), F.col("fields").alias(f"{side}_fields"),
                                        F.when(F.size("sets") > 1, F.col("sets")).alias(f"{side}_sets"))
    outs = of(left, "source").join(maybe_broadcast(pairs, PAIRS_AT_ONCE), "source_process").drop("source_process")
    met = join_spread(outs, of(right, "target"), ["target_process", "dataset"], PAIR_BLOCK)
    # without two arrays of several datasets a pair shares one at most
    several = F.col("source_sets").isNotNull() & F.col("target_sets").isNotNull()
    rows = met.filter(~several | (F.col("dataset") == F.array_min(F.array_intersect("source_sets", "target_sets")))) \
        .drop("dataset", "target_process", "source_sets", "target_sets")
    return _field_mappings(rows).withColumn("mapping_id", short_id("source_component", "target_component", "target_column")).select(
        "source_column", "source_type", "target_column", "target_type", "is_derived", "mapping_type", "source_component", "target_component", "mapping_id")


def sttm_report(mappings: DataFrame, order: list, process_name="process_name", system="system") -> DataFrame:
    """The 24-column report with ids numbered in the given order.

    Columns of `mappings` that bear the lower-case name of a report column fill it (flags as booleans);
    without one, keys are N, nullable is Y, confidence 1 and texts are empty. Only columns that the report shows are
    staged; where components come in ranges (`scale.ranged`) of the first column of the order, mappings do not move.
    """
    shown = {"_process", "_system", "source_type", "target_type", "rule", *[c.lower() for c in REPORT_COLUMNS]}
    named = mappings.withColumns({"_process": as_col(process_name), "_system": as_col(system)})
    rows = number_rows(named, order, name="_no", columns=[c for c in named.columns if c.lower() in shown])
    given = lambda c: F.col(c.lower()) if c.lower() in mappings.columns else F.lit(None)
    flag = lambda c, default: F.coalesce(F.when(given(c).cast("boolean"), "Y").when(~given(c).cast("boolean"), "N"), F.lit(default))
    number = F.col("_no").cast("string")
    known = {
        "STTM_ID": F.concat(F.lit("sttm_"), F.when(F.col("_no") < 100_000, F.lpad(number, 5, "0")).otherwise(number)),
        "Process_Name": F.col("_process"), "System": F.col("_system"),
        "Source_Table": F.col("source_table"), "Source_Column": F.col("source_column"), "Source_Datatype": F.col("source_type"),
        "Target_Table": F.col("target_table"), "Target_Column": F.col("target_column"), "Target_Datatype": F.col("target_type"),
        "Source_Is_PK": flag("Source_Is_PK", "N"), "Source_Is_Nullable": flag("Source_Is_Nullable", "Y"),
        "Target_Is_PK": flag("Target_Is_PK", "N"), "Target_Is_Nullable": flag("Target_Is_Nullable", "Y"),
        "Processing_Order": F.col("processing_order"),
        "Transformation_Rule": F.coalesce(F.nullif(F.col("rule"), F.lit("")), F.lit("Direct mapping")),
        "Mapping_Type": F.col("mapping_type"), "Mapping_Confidence": F.coalesce(given("Mapping_Confidence").cast("double"), F.lit(1.0)),
    }
    return rows.select(*[known.get(c, F.coalesce(given(c).cast("string"), F.lit(""))).alias(c) for c in REPORT_COLUMNS])


def processing_order(components: DataFrame) -> DataFrame:
    """Output fields of a component with their position from 1."""
    return components.select("component_id", F.posexplode("out_fields").alias("pos", "field")).select(
        "component_id", (F.col("pos") + 1).alias("processing_order"), F.col("field.name").alias("target_column"))


def sttm_summary(mappings: DataFrame) -> DataFrame:
    """One row: totals, counts per mapping type, distinct non-empty tables."""
    kinds = ["direct", "derived", "lookup", "calculated"]
    return mappings.agg(
        F.count("*").alias("total_mappings"),
        *[F.count_if(F.col("mapping_type") == k).alias(f"{k}_mappings") for k in kinds],
        F.countDistinct(F.nullif("source_table", F.lit(""))).alias("source_tables"),
        F.countDistinct(F.nullif("target_table", F.lit(""))).alias("target_tables"))


def filter_sttm(mappings: DataFrame, pii_only=False, min_confidence=0.0, field_types=None) -> DataFrame:
    out = mappings.filter(F.col("confidence") >= min_confidence)
    if pii_only:
        out = out.filter("contains_pii")
    return out.filter(F.col("field_type").isin(*field_types)) if field_types else out


def logic_level(mappings: DataFrame, logic="rule", source="source_column") -> DataFrame:
    """Per transformation text: fields, distinct sources, complexity. Counts, not lists:
    one text such as "Direct mapping" may hold a large part of all rows."""
    n = F.count("*")
    return mappings.groupBy(F.col(logic).alias("logic")).agg(
        n.alias("field_count"), F.countDistinct(F.nullif(F.col(source), F.lit(""))).alias("source_fields"),
        F.when(n > 10, "HIGH").when(n > 5, "MEDIUM").otherwise("LOW").alias("complexity"))


def logic_fields(mappings: DataFrame, logic="rule", source="source_column") -> DataFrame:
    """The distinct (logic, source field) rows behind `logic_level`."""
    return mappings.filter(F.col(source) != "").select(F.col(logic).alias("logic"), F.col(source).alias("source_field")).distinct()


def sttm_quality(mappings: DataFrame) -> DataFrame:
    """One row: mean confidence to two digits, fields with personal data, distinct targets."""
    return mappings.agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("confidence"),
                        F.count_if("contains_pii").alias("pii_fields"),
                        F.countDistinct("target_table").alias("target_tables"))


def column_level(mappings: DataFrame) -> DataFrame:
    """Column derivation rows of a report."""
    return mappings.select(
        F.col("target_column").alias("column_name"), "target_table",
        F.col("source_column").alias("source_columns"), F.col("source_table").alias("source_dataset"),
        F.col("rule").alias("transformation_logic"), F.col("target_type").alias("data_type"), "processing_order")
