"""Gaps between a source and a target system, and their summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage, dealt
from estatelens.functions.text import as_col, contains_any, short_id


def is_quality_check(condition) -> Column:
    """True when a predicate looks like a data-quality check."""
    return contains_any(F.lower(F.coalesce(as_col(condition), F.lit(""))), vocab.QUALITY_WORDS)


def missing(source: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Source rows without a match, as critical gaps."""
    return source.join(matched.select(key).distinct(), key, "left_anti").select(
        short_id(F.lit("missing"), key).alias("gap_id"), F.lit("missing_process").alias("gap_type"),
        F.lit("critical").alias("severity"), key)


def missing_workflows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Workflow keys of the source that the target lacks."""
    return source.select(key).distinct().join(target.select(key).distinct(), key, "left_anti").select(
        F.concat(F.lit("workflow_missing_"), F.col(key)).alias("gap_id"), F.lit("missing_workflow").alias("gap_type"),
        F.lit("high").alias("severity"), key)


def missing_items(pairs: DataFrame, source: DataFrame, target: DataFrame, gap_type: str) -> DataFrame:
    """Items (tables or columns) of the source side of a pair that the target side lacks.

    `pairs` has (source_id, target_id); `source` and `target` have (id, item). One row per
    missing item, so a pair with very many items stays spread over tasks.
    """
    tables = gap_type == "data_coverage"
    item = (F.col("item") if tables else F.lower("item")).alias("item")  # column names match in any case
    have = source.select(F.col("id").alias("source_id"), item).distinct().join(pairs, "source_id")
    want = target.select(F.col("id").alias("target_id"), item).distinct()
    prefix = "data" if tables else "col"
    return have.join(want, ["target_id", "item"], "left_anti").select(
        short_id(F.lit(prefix), "source_id", "target_id").alias("gap_id"), F.lit(gap_type).alias("gap_type"),
        F.lit("high" if tables else "medium").alias("severity"), "source_id", "target_id", "item")


FIELDS_PER_TASK = 2_000_000


def _packed(fields: DataFrame) -> DataFrame:
    """(id, item) with the items of rows of one id that follow each other as an array, without moving any."""
    def run(batches):
        for batch in batches:
            ids, items = batch.columns
            if not len(ids):
                continue
            new = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            ends = pa.array(np.concatenate([starts, [len(ids)]]), pa.int32())
            yield pa.record_batch([ids.take(pa.array(starts)), pa.ListArray.from_arrays(ends, items)], names=["id", "item"])

    kept = T.StructType([T.StructField("id", fields.schema["id"].dataType), T.StructField("item", T.ArrayType(T.StringType()))])
    return fields.select("id", "item").mapInArrow(run, kept).withColumn("item", F.array_sort(F.array_distinct("item")))


def missing_component_columns(equivalents: DataFrame, fields: DataFrame) -> DataFrame:
    """Output columns of a component that its equivalent in the other system lacks, in any case of letters.

    `equivalents` has (source_component, target_component), `fields` (component_id, field) of both sides. Components
    without any output field are not compared. One row per missing column; a null is missing anywhere.
    """
    # a row per component moves, not one per field
    packs = cut_lineage(_packed(fields.select(F.col("component_id").alias("id"), F.lower("field").alias("item"))))
    # equal rows meet in tasks of a bounded number of rows: nearly all differ, so a task's share of the scan would be held whole
    packs = cut_lineage(dealt(packs, FIELDS_PER_TASK, "id", "item").distinct())
    sets = packs.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("item"))).alias("items"))
    side = lambda name: sets.select(F.col("id").alias(f"{name}_component"), F.col("items").alias(f"{name}_items")).hint("merge")
    both = equivalents.select("source_component", "target_component").join(side("source"), "source_component").join(side("target"), "target_component")
    named = F.filter("source_items", lambda x: x.isNotNull())
    nulls = F.filter("source_items", lambda x: x.isNull())
    return both.select(
        short_id(F.lit("col"), "source_component", "target_component").alias("gap_id"), F.lit("missing_columns").alias("gap_type"),
        F.lit("medium").alias("severity"), "source_component", "target_component",
        F.explode(F.concat(F.array_except(named, "target_items"), nulls)).alias("item"))


def count_mismatch(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs whose sides have different row counts; both tables have a column `id`."""
    counted = lambda df, side: df.groupBy(F.col("id").alias(f"{side}_id")).agg(F.count("*").alias(f"{side}_count"))
    out = pairs.join(counted(source, "source"), "source_id", "left").join(counted(target, "target"), "target_id", "left") \
        .fillna(0, ["source_count", "target_count"])
    return out.filter(F.col("source_count") != F.col("target_count")).select(
        short_id(F.lit("logic"), "source_id", "target_id").alias("gap_id"), F.lit("logic_difference").alias("gap_type"),
        F.lit("high").alias("severity"), "source_id", "target_id", "source_count", "target_count")


def level_flags(texts: DataFrame) -> DataFrame:
    """Per id: mentions the account level, mentions the person level, over all its texts."""
    low = F.lower("text")
    seen = lambda w: F.bool_or(low.contains(w))
    acct = vocab.LEVEL_WORDS["account"]
    return texts.groupBy("id").agg((seen(acct[0]) & seen(acct[1])).alias("account_level"),
                                   seen(vocab.LEVEL_WORDS["person"][0]).alias("person_level"))


def level_mismatch(pairs: DataFrame, source_texts: DataFrame, target_texts: DataFrame) -> DataFrame:
    """Pairs with account level in the source and only person level in the target.

    Word flags are aggregated text by text instead of joining all texts of a process.
    """
    flags = lambda df, side: level_flags(df).select(
        F.col("id").alias(f"{side}_id"), F.col("account_level").alias(f"{side}_account"), F.col("person_level").alias(f"{side}_person"))
    out = pairs.join(flags(source_texts, "source"), "source_id").join(flags(target_texts, "target"), "target_id")
    return out.filter(F.col("source_account") & F.col("target_person") & ~F.col("target_account")).select(
        short_id(F.lit("agg"), "source_id", "target_id").alias("gap_id"), F.lit("aggregation_level").alias("gap_type"),
        F.lit("high").alias("severity"), "source_id", "target_id")


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Counts by type, by severity and in total."""
    gaps = gaps.select("gap_type", "severity")
    return gaps.groupingSets([["gap_type"], ["severity"], []], "gap_type", "severity").agg(
        F.count("*").alias("gaps"))


def critical_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.filter(F.col("severity") == "critical")


def transformation_counts(steps: DataFrame, script="script_id", kind="kind") -> DataFrame:
    """Steps per (system, script, kind) with subtotals per script, system and overall."""
    return steps.rollup("system", script, kind).agg(F.count("*").alias("steps"))


def kind_counts(steps: DataFrame, source: str, target: str) -> DataFrame:
    return steps.groupBy("kind").agg(F.count_if(F.col("system") == source).alias("source_count"),
                                     F.count_if(F.col("system") == target).alias("target_count"))


def transformation_gaps(steps: DataFrame, source: str, target: str) -> DataFrame:
    """Kinds the target lacks (high) or covers by less than half (medium)."""
    rows = kind_counts(steps, source, target).filter(F.col("source_count") > 0)
    none = F.col("target_count") == 0
    few = F.col("target_count") < F.col("source_count") * 0.5
    return rows.filter(none | few).select(
        F.when(none, "missing_transformation_type").otherwise("incomplete_transformation_coverage").alias("gap_type"),
        F.when(none, "high").otherwise("medium").alias("severity"), "kind", "source_count", "target_count",
        F.when(~none, F.round(F.col("target_count") / F.col("source_count") * 100, 2)).alias("coverage_percent"))


def quality_gaps(steps: DataFrame, source: str, target: str) -> DataFrame:
    """Quality checks: none in the target (critical) or below 70 percent (high)."""
    checks = steps.filter((F.col("kind") == "filter") & is_quality_check("condition"))
    row = checks.agg(F.count_if(F.col("system") == source).alias("source_checks"),
                     F.count_if(F.col("system") == target).alias("target_checks"))
    none = (F.col("source_checks") > 0) & (F.col("target_checks") == 0)
    few = F.col("target_checks") < F.col("source_checks") * 0.7
    return row.filter(none | few).select(
        F.when(none, "missing_data_quality").otherwise("incomplete_data_quality").alias("gap_type"),
        F.when(none, "critical").otherwise("high").alias("severity"), "source_checks", "target_checks",
        F.when(~none, F.round(F.col("target_checks") / F.col("source_checks") * 100, 2)).alias("coverage_percent"))


def missing_rules(steps: DataFrame, source: str, target: str, min_chars: int = 10) -> DataFrame:
    """Distinct rules of the source that the target lacks.

    Rules are conditions longer than `min_chars` and, where the column exists, meanings.
    """
    def rules(system):
        own = steps.filter(F.col("system") == system)
        out = own.filter(F.length("condition") > min_chars).select(F.col("condition").alias("rule"))
        if "meaning" in steps.columns:
            out = out.unionByName(own.filter(F.length("meaning") > 0).select(F.col("meaning").alias("rule")))
        return out.distinct()

    return rules(source).join(rules(target), "rule", "left_anti")


def rule_gaps(steps: DataFrame, source: str, target: str, sample: int) -> DataFrame:
    """One row: number of missing rules and the first few of them in sort order."""
    lost = missing_rules(steps, source, target)
    first = lost.orderBy("rule").limit(sample).agg(F.array_sort(F.collect_list("rule")).alias("sample_rules"))
    # both sides are aggregates of one row
    return lost.agg(F.count("*").alias("missing_rules")).filter("missing_rules > 0").crossJoin(first).select(
        F.lit("missing_business_logic").alias("gap_type"), F.lit("high").alias("severity"), "missing_rules", "sample_rules")


def io_gaps(scripts: DataFrame, source: str, target: str) -> DataFrame:
    """Totals of reads and writes of the target below half of the source (arrays reads, writes)."""
    total = lambda system, c: F.coalesce(F.sum(F.when(F.col("system") == system, F.size(c))), F.lit(0))
    row = scripts.agg(total(source, "reads").alias("si"), total(target, "reads").alias("ti"),
                      total(source, "writes").alias("so"), total(target, "writes").alias("to"))
    items = F.array(
        F.struct(F.lit("incomplete_inputs").alias("gap_type"), F.col("si").alias("source_total"), F.col("ti").alias("target_total")),
        F.struct(F.lit("incomplete_outputs").alias("gap_type"), F.col("so").alias("source_total"), F.col("to").alias("target_total")))
    return row.select(F.explode(items).alias("i")).select("i.*").withColumn("severity", F.lit("medium")) \
        .filter((F.col("source_total") > 0) & (F.col("target_total") < F.col("source_total") * 0.5))


def gaps_by_severity(gaps: DataFrame, by="gap_type") -> DataFrame:
    """One row per type with a column per severity."""
    return gaps.groupBy(by).pivot("severity", vocab.SEVERITIES).agg(F.count(F.lit(1))).fillna(0)


def comparison_stats(scripts: DataFrame, steps: DataFrame, gaps: DataFrame, source: str, target: str) -> DataFrame:
    """One row: workflows, scripts and steps per side, gaps by severity and in total."""
    side = lambda df, name, f: df.agg(f(source).alias(f"source_{name}"), f(target).alias(f"target_{name}"))
    a = side(scripts, "scripts", lambda s: F.count_if(F.col("system") == s))
    b = side(scripts, "workflows", lambda s: F.countDistinct(F.when(F.col("system") == s, F.col("name"))))
    c = side(steps, "steps", lambda s: F.count_if(F.col("system") == s))
    d = gaps.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}_gaps") for s in vocab.SEVERITIES],
                 F.count("*").alias("total_gaps"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four aggregates of one row each


def assess_complexity(stats: DataFrame) -> DataFrame:
    """Migration complexity from the gap counts."""
    critical, high, total = F.col("critical_gaps"), F.col("high_gaps"), F.col("total_gaps")
    level = (F.when((critical > 5) | (total > 50), "very_high").when((critical > 0) | (high > 10), "high")
             .when((high > 0) | (total > 10), "medium").otherwise("low"))
    return stats.withColumn("complexity", level)


def gap_recommendations(gaps: DataFrame) -> DataFrame:
    """Recommendation rows from counts of severities and gap types."""
    n = lambda *types: F.count_if(F.col("gap_type").isin(*types))
    row = gaps.agg(F.count_if(F.col("severity") == "critical").alias("critical"),
                   F.count_if(F.col("severity") == "high").alias("high"),
                   n("missing_workflow").alias("workflows"),
                   n("missing_data_quality", "incomplete_data_quality").alias("quality"),
                   n("missing_transformation_type").alias("kinds"))
    item = lambda c, code: F.when(F.col(c) > 0, F.struct(F.lit(code).alias("code"), F.col(c).alias("n")))
    items = F.array_compact(F.array(
        item("critical", "address_critical"), item("high", "fix_high"), item("workflows", "implement_workflows"),
        item("quality", "strengthen_quality"), item("kinds", "implement_transformations")))
    return row.select(F.explode(items).alias("i")).select("i.*")
