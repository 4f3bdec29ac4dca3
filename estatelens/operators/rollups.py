"""Roll-ups of repositories, projects, notebooks and collections; order within workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import number_rows
from estatelens.functions.text import as_col


def repository_rollup(components: DataFrame, repo="system") -> DataFrame:
    """Per repository and component type, with subtotals: components, processes, datasets.

    Distinct values are counted in long form: each (kind, value) meets once, with the set of groups it stands in, and
    counts for each of them, for each repository among them, and for the total. Rows are reduced per task before that one exchange.
    """
    kinds = {"processes": "process_id", "sources": "input_dataset", "targets": "output_dataset"}
    own = F.struct(F.col(repo).alias("r"), F.col("component_type").alias("t"))
    values = components.select(own.alias("g"), F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds.items()])).alias("v")) \
        .where("v.value is not null").groupBy("v.kind", "v.value").agg(F.collect_set("g").alias("groups"))
    at = lambda level, r, t: F.struct(F.lit(level).alias("level"), r.cast("string").alias("r"), t.cast("string").alias("t"))
    none = F.lit(None)
    levels = F.concat(F.transform("groups", lambda g: at(2, g["r"], g["t"])),
                      F.transform(F.array_distinct(F.transform("groups", lambda g: g["r"])), lambda r: at(1, r, none)), F.array(at(0, none, none)))
    distinct = values.select("kind", F.explode(levels).alias("g")).groupBy("g").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds]).select("g.*", *kinds)
    rows = components.rollup(repo, "component_type").agg(F.count("*").alias("components"), F.grouping_id().alias("id"))
    level = F.when(F.col("id") == 0, 2).when(F.col("id") == 1, 1).otherwise(0)
    return rows.join(distinct, (level == F.col("level")) & F.col(repo).eqNullSafe(F.col("r")) & F.col("component_type").eqNullSafe(F.col("t")), "left") \
        .select(repo, "component_type", "components", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def repository_datasets(components: DataFrame, repo="system") -> DataFrame:
    """Distinct datasets of a repository as rows (direction, dataset)."""
    return components.select(repo, F.explode(F.array(
        F.struct(F.lit("source").alias("direction"), F.col("input_dataset").alias("dataset")),
        F.struct(F.lit("target").alias("direction"), F.col("output_dataset").alias("dataset")))).alias("d")) \
        .select(repo, "d.*").distinct()


def repository_domains(processes: DataFrame, repo="system", name="name") -> DataFrame:
    """Business domains of a repository, from words in its workflow names."""
    low = F.lower(as_col(name))
    hits = F.array_compact(F.array(*[F.when(low.contains(k), v) for k, v in vocab.REPOSITORY_DOMAINS.items()]))
    return processes.select(repo, F.explode(hits).alias("domain")).distinct()


def project_summary(components: DataFrame) -> DataFrame:
    """Graphs, components, parameters and flows per project and in total."""
    return components.rollup("project").agg(
        F.countDistinct("graph").alias("graphs"), F.count("*").alias("components"),
        F.sum("parameters").alias("parameters"), F.sum("flows").alias("flows"))


def notebook_summary(notebooks: DataFrame, group="path_group") -> DataFrame:
    """Notebooks, parameters and dependencies per group (arrays parameters, imports)."""
    return notebooks.groupBy(group).agg(
        F.count("*").alias("notebooks"), F.sum(F.size("parameters")).alias("parameters"),
        F.sum(F.size("imports")).alias("dependencies"))


def collection_stats(docs: DataFrame, by="source") -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("documents"))


def execution_order(notebooks: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """Notebooks in order of their number of imports, stable; numbered per group."""
    ranked = notebooks.withColumn("n_imports", F.size("imports")).drop("imports")
    return number_rows(ranked, ["n_imports", ordinal], group, "execution_order")


def ordered_actions(actions: DataFrame, workflow: str, order: list) -> DataFrame:
    """Actions with their position in the workflow, as rows."""
    return number_rows(actions, order, [workflow], "position")


def sequence_edges(actions: DataFrame, workflow: str, action: str, order: list) -> DataFrame:
    """Edges between consecutive actions, with entry and exit marks.

    Consecutive rows meet through an equality join on (workflow, position), so a workflow
    of any length stays spread over tasks.
    """
    rows = ordered_actions(actions, workflow, order).select(workflow, action, "position")
    last = rows.groupBy(workflow).agg(F.max("position").alias("last"))
    after = rows.select(workflow, F.col(action).alias("to_action"), (F.col("position") - 1).alias("position"))
    return rows.join(after, [workflow, "position"]).join(last, workflow).select(
        workflow, F.col(action).alias("from_action"), "to_action", "position",
        (F.col("position") == 1).alias("from_entry"), (F.col("position") + 1 == F.col("last")).alias("to_exit"))


def flow_text(actions: DataFrame, workflow: str, name: str, kind: str, order: list, limit: int | None = None) -> DataFrame:
    """Text of all actions per workflow, or of the first `limit` and how many more there are.

    Row numbers up to a limit let Spark keep `limit` rows per workflow and task before the
    shuffle; only those rows are put together.
    """
    first = actions.withColumn("_no", F.row_number().over(Window.partitionBy(workflow).orderBy(*order))) \
        .filter(F.lit(True) if limit is None else F.col("_no") <= limit)
    line = F.concat(F.lit("["), F.col("_no").cast("string"), F.lit("] "), F.col(name), F.lit(" ("), F.col(kind), F.lit(")"))
    texts = first.groupBy(workflow).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_no", line.alias("t")))), lambda s: s["t"]), "\n    ↓\n").alias("shown"))
    totals = actions.groupBy(workflow).agg(F.count("*").alias("actions"))
    more = F.lit("") if limit is None else F.when(F.col("actions") > limit, F.concat(
        F.lit("\n    ... and "), (F.col("actions") - limit).cast("string"), F.lit(" more actions"))).otherwise("")
    return texts.join(totals, workflow).select(workflow, "actions", F.concat("shown", more).alias("flow_text"))


def diagram_text(edges: DataFrame, workflow: str, src: str, dst: str, order: list, limit: int | None = None) -> DataFrame:
    """Mermaid text of all edges per workflow, or of the first `limit`."""
    first = edges.withColumn("_no", F.row_number().over(Window.partitionBy(workflow).orderBy(*order))) \
        .filter(F.lit(True) if limit is None else F.col("_no") <= limit)
    safe = lambda c: F.regexp_replace(as_col(c), "[-:]", "_")
    line = F.concat(F.lit("    "), safe(src), F.lit(" --> "), safe(dst))
    return first.groupBy(workflow).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_no", line.alias("t")))), lambda s: s["t"]), "\n")).alias("diagram"))


def sample_every(array, step: int, limit: int | None = None) -> Column:
    """Every `step`-th element, all or the first `limit` of them."""
    every = F.filter(as_col(array), lambda x, i: i % step == 0)
    return every if limit is None else F.slice(every, 1, limit)
