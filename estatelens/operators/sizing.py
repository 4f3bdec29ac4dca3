"""Workflow sizes, effort estimates and references to scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import as_col, effort_text

# --- Fixed values: hours per unit of work --------------------------------------
HOURS = {
    "discovery": 2.0, "per_action": 0.2, "code_reading": 0.5, "mapping": 1.0, "per_table": 0.1,
    "documentation": 1.0, "validation": 1.0, "per_script": 0.3, "comparison": 2.0,
}
FACTORS = {"Big Pipeline": 1.3, "Medium": 1.1, "Small": 1.0}
HOURS_PER_DAY = 8


def size_class(scripts) -> Column:
    n = as_col(scripts)
    return F.when(n <= 2, "Small").when(n <= 6, "Medium").otherwise("Big Pipeline")


def estimate_effort(flows: DataFrame) -> DataFrame:
    """Size class and effort from scripts, loc, actions, tables; days rounded to halves."""
    h = HOURS
    scripts, loc = F.col("scripts"), F.col("loc")
    parts = {
        "discovery_hours": h["discovery"] + F.col("actions") * h["per_action"],
        "code_reading_hours": scripts * h["code_reading"] * (1 + loc / 1000),
        "mapping_hours": scripts * h["mapping"] * (1 + F.col("tables") * h["per_table"]),
        "documentation_hours": F.lit(h["documentation"]),
        "validation_hours": h["validation"] + scripts * h["per_script"],
        "comparison_hours": F.lit(h["comparison"]),
    }
    total = F.lit(0.0)
    for p in parts.values():
        total = total + p
    out = flows.withColumn("size_class", size_class("scripts"))
    factor = F.lit(1.0)
    for name, value in FACTORS.items():
        factor = F.when(F.col("size_class") == name, value).otherwise(factor)
    days = F.bround((total * factor / HOURS_PER_DAY * 2).cast("double")) / 2
    out = out.withColumn("effort_days", days).withColumn("effort_hours", F.col("effort_days") * HOURS_PER_DAY)
    for name, p in parts.items():
        out = out.withColumn(name, F.bround(p.cast("double"), 1))
    return out.withColumn("effort_text", effort_text("effort_hours", "effort_days"))


def portfolio_summary(flows: DataFrame) -> DataFrame:
    """Totals by size class and overall: flows, scripts, missing scripts, days, hours."""
    return flows.rollup("size_class").agg(
        F.count("*").alias("flows"), F.sum("scripts").alias("scripts"), F.sum("missing").alias("missing"),
        F.sum("effort_days").alias("effort_days"), F.sum("effort_hours").alias("effort_hours"))


def match_scripts(references: DataFrame, inventory: DataFrame) -> DataFrame:
    """References by file name: the first path of that name, or missing.

    The inventory is reduced to one row per name first, so a name found in many folders
    does not multiply references.
    """
    first = inventory.groupBy("name").agg(F.min("path").alias("path"))
    return references.join(first, "name", "left").withColumn(
        "status", F.when(F.col("path").isNull(), "missing").otherwise("found"))


def used_scripts(inventory: DataFrame, references: DataFrame) -> DataFrame:
    """Inventory with a flag for names that some workflow references."""
    used = references.select("name").distinct().withColumn("_used", F.lit(True))
    return inventory.join(used, "name", "left").withColumn("used", F.coalesce("_used", F.lit(False))).drop("_used")
