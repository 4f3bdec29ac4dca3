"""Lineage graphs as edge tables: build, reach, trace, layer, endpoints.

Loops run one join per level and stop on an empty frontier. Each level is written to the
shared folder, so plans stay short and a lost executor costs one level at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.scale import cut_lineage, cut_lineage_by, shared_folder


def _rounds(most: int | None) -> Iterable[int]:
    """1, 2, ... up to `most`; None: as long as the loop finds something."""
    return count(1) if most is None else range(1, most + 1)


def lineage_graph(locations: DataFrame, script="script") -> DataFrame:
    """Edges (source_id, target_id, edge_type, script) between locations and scripts.

    `locations` has (script, direction, location_type, location).
    """
    place = F.concat_ws(":", "location_type", "location")
    node = F.concat(F.lit("script:"), F.col(script))
    reads = F.col("direction") == "read"
    return dedup_edges(locations.select(
        F.when(reads, place).otherwise(node).alias("source_id"),
        F.when(reads, node).otherwise(place).alias("target_id"),
        F.when(reads, "reads").otherwise("writes").alias("edge_type")))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes with their type and name."""
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    kind = F.when(F.col("node_id").startswith("script:"), "script").otherwise("data_location")
    return ids.select("node_id", kind.alias("node_type"),
                      F.regexp_extract("node_id", r"^[^:]*:(.*)$", 1).alias("name"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["source_id", "target_id", "edge_type"])


def reach(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """Nodes that the start nodes reach, within `max_depth` steps if given, with the least depth.

    `edges` has (src, dst), `starts` has (node). Start nodes are not returned; cycles end
    because visited nodes never enter the frontier again.
    """
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    steps = cut_lineage(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    frontier = starts.select("node").distinct()
    visited = frontier.withColumn("depth", F.lit(0))
    for depth in _rounds(max_depth):
        # frontier nodes are unique, so a node with very many edges is only read, not multiplied
        found = steps.join(frontier, "node").select(F.col("next").alias("node")).distinct()
        frontier = cut_lineage(found.join(visited.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return visited.filter(F.col("depth") > 0)


def trace_scripts(reads: DataFrame, writes: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(script, hop) of the scripts that are met on the way from the start tables, at their first hop.

    `reads` and `writes` have (script, tab), `start` has (tab). A script is visited once; its
    output tables feed the next hop. A level has one row per script, whatever it reads and writes.
    """
    frontier, hops = start.select("tab").distinct(), None
    for hop in _rounds(max_hops):
        scripts = reads.join(frontier, "tab").select("script").distinct()
        if hops is not None:
            scripts = scripts.join(hops.select("script"), "script", "left_anti")
        level = cut_lineage(scripts.withColumn("hop", F.lit(hop)))
        if level.isEmpty():
            break
        hops = level if hops is None else hops.unionByName(level)
        # tables of earlier hops may come again: all scripts that read them are done
        frontier = writes.join(level, "script", "left_semi").select("tab").distinct()
    return hops if hops is not None else reads.limit(0).select("script", F.lit(0).alias("hop"))


def _script_edges(reads: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both written once, reads in buckets of tables, writes in buckets of scripts, so that a hop moves its frontier only."""
    return cut_lineage_by(reads.select("script", "tab"), "tab"), cut_lineage_by(writes.select("script", "tab"), "script")


def trace_edges(reads: DataFrame, writes: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Rows (hop, script, direction, tab): what each script met on the way reads and writes.

    A script with r reads and w writes has r + w rows; `hop_pairs` multiplies them where asked.
    """
    reads, writes = _script_edges(reads, writes)
    hops = trace_scripts(reads, writes, start, max_hops)
    side = lambda edges, name: edges.join(hops, "script").select("hop", "script", F.lit(name).alias("direction"), "tab")
    return side(reads, "read").unionByName(side(writes, "write"))


def hop_pairs(hop_edges: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """(hop, script, source_table, target_table): every read with every write of a script.

    `scripts` (script) names the scripts to list; None: all. The result is as long as that
    product, so ask for the scripts that are looked at.
    """
    rows = hop_edges if scripts is None else hop_edges.join(scripts.select("script").distinct(), "script", "left_semi")
    side = lambda name, column: rows.filter(F.col("direction") == name).select("hop", "script", F.col("tab").alias(column))
    return side("read", "source_table").join(side("write", "target_table"), ["hop", "script"]) \
        .select("hop", "script", "source_table", "target_table")


def trace_table(reads: DataFrame, writes: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Hops from tables through the scripts that read them to the tables those write, all pairs of a script."""
    reads, writes = _script_edges(reads, writes)
    return trace_scripts(reads, writes, start, max_hops).join(reads.withColumnRenamed("tab", "source_table"), "script") \
        .join(writes.withColumnRenamed("tab", "target_table"), "script") \
        .select("hop", "script", "source_table", "target_table")


def trace_column(lineage: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Steps of columns across scripts: rows of `lineage` with their first hop number.

    `lineage` has (script, source_table, source_column, target_table, target_column),
    `start` has (tab, col).
    """
    rows = cut_lineage(lineage.distinct())
    known = start.select("tab", "col").distinct()
    frontier, out = known, None
    source = (F.col("source_table") == F.col("tab")) & (F.col("source_column") == F.col("col"))
    for hop in _rounds(max_hops):
        step = cut_lineage(rows.join(frontier, source, "left_semi").withColumn("hop", F.lit(hop)))
        if step.isEmpty():
            break
        out = step if out is None else out.unionByName(step)
        targets = step.select(F.col("target_table").alias("tab"), F.col("target_column").alias("col")).distinct()
        frontier = targets.join(known, ["tab", "col"], "left_anti")
        known = known.unionByName(targets)
    return out if out is not None else rows.limit(0).withColumn("hop", F.lit(0))


def hop_graph(hops: DataFrame) -> DataFrame:
    """Edge rows between `table_column` nodes of hop rows."""
    node = lambda side: F.concat_ws("_", f"{side}_table", F.coalesce(F.col(f"{side}_column"), F.lit("table")))
    return hops.select(node("source").alias("from_node"), node("target").alias("to_node"), "script").distinct()


def chain_ends(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the chains of nodes with one parent start: (node, root, dist), and the nodes (node) on or behind a cycle of them.

    `parents` has (node, parent), one row per node; a root is a parent without a row. Pointers
    double each round, so a chain of n nodes takes log n rounds; a round without a new end
    leaves only cycles, as the node next beyond the reach of the last round would have ended.
    """
    inner = parents.select(F.col("node").alias("parent"), F.lit(True).alias("inner"))
    first = cut_lineage(parents.join(inner, "parent", "left").select(
        "node", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("dist"), F.col("inner").isNull().alias("ended")))
    ended, waiting = first.filter("ended"), first.filter("NOT ended")
    left = waiting.count()
    while left:
        reach = ended.unionByName(waiting).select(F.col("node").alias("at"), F.col("root").alias("to"), F.col("dist").alias("more"), F.col("ended").alias("end"))
        step = cut_lineage(waiting.join(reach, waiting["root"] == reach["at"]).select(
            "node", F.col("to").alias("root"), (F.col("dist") + F.col("more")).alias("dist"), F.col("end").alias("ended")))
        ended, waiting = ended.unionByName(step.filter("ended")), step.filter("NOT ended")
        before, left = left, waiting.count()
        if left == before:
            break
    return ended.select("node", "root", "dist"), waiting.select("node")


def _peel(links: DataFrame, opens: DataFrame, free: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """Layers (node, layer) of the nodes that become free after `free` (node, layer) in at most `most` rounds, and how many nodes
    of `opens` are left that a further round may free (0: none is left, or a round freed nothing).

    `links` has (src, node, ways, length), `opens` (node, open) the number of ways into each node. A round takes the links of the
    nodes just freed off the counters of their successors; a counter at 0 frees the successor. It writes the counters that
    changed, so that links are joined once per round, and the free nodes.
    """
    spark = links.sparkSession
    folder = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    held = 1_000_000 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = lambda rows, place: spark.read.schema(rows.schema).parquet(f"{folder}/{place}")
    left, found, layers, hits = opens.count(), free.count(), free.limit(0), None
    for step in _rounds(most):
        if not (left and found):
            return layers, 0
        heads = free.select(F.col("node").alias("src"), "layer")
        # nodes are unique, so a task that hashes its share of them holds about a million; few are left to Spark, more are sorted
        closed = links.join(heads.hint("shuffle_hash") if 100_000 < found <= held else heads, "src") \
            .groupBy("node").agg(F.sum("ways").alias("closed"), F.max(F.col("layer") + F.col("length")).alias("layer"))
        closed.write.parquet(f"{folder}/hits-{step}")
        now, hits = stored(closed, f"hits-{step}"), stored(closed, "hits-*")
        total = now if step == 1 else hits.join(now.select("node"), "node", "left_semi") \
            .groupBy("node").agg(F.sum("closed").alias("closed"), F.max("layer").alias("layer"))
        freed = total.join(opens, "node").filter("closed = open").select("node", "layer")
        freed.write.parquet(f"{folder}/free-{step}")
        free, layers = stored(freed, f"free-{step}"), stored(freed, "free-*")
        found = free.count()
        left -= found
    return layers, left if found else 0


def topo_layers(edges: DataFrame, plain_rounds: int = 4) -> DataFrame:
    """Layer per node of an acyclic graph (the longest way from a node without predecessors); nodes on or behind a cycle get no layer.

    `edges` has (src, dst). The first `plain_rounds` rounds take the edges as they are, which is all that a shallow graph needs.
    In what is deeper, nodes with one predecessor lie on chains, which are contracted; then rounds are only needed
    between nodes with several. Edges are written once.
    """
    steps = cut_lineage(edges.select("src", "dst").distinct())
    side = lambda name, entered: steps.select(F.col(name).alias("node"), F.lit(entered).alias("open"))
    nodes = cut_lineage(side("src", 0).unionByName(side("dst", 1)).groupBy("node").agg(F.sum("open").alias("open")))
    named = nodes.filter("node IS NOT NULL")
    roots = named.filter("open = 0").select("node", F.lit(0).cast("bigint").alias("layer"))
    plain = steps.select("src", F.col("dst").alias("node"), F.lit(1).alias("ways"), F.lit(1).alias("length"))
    layers, left = _peel(plain, named.filter("open > 0"), roots, plain_rounds)
    layers = roots.unionByName(layers)
    if left:
        layers = layers.unionByName(_deep_layers(steps, named, layers))
    return nodes.select("node").join(layers, "node", "left").select("node", F.col("layer").cast("int").alias("layer"))


def _deep_layers(steps: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Layers (node, layer) of the nodes (node, open) without one in `known` (node, layer). All steps of a chain end at its root,
    so parallel ways between two nodes are one link: how many, and the longest."""
    rest = cut_lineage(nodes.filter("open > 0").join(known, "node", "left_anti"))
    steps = cut_lineage(steps.join(rest.select(F.col("node").alias("dst"), "open"), "dst"))
    chained, cyclic = chain_ends(steps.filter("open = 1").select(F.col("dst").alias("node"), F.col("src").alias("parent")))
    ends = chained.select(F.col("node").alias("src"), "root", "dist")
    links = cut_lineage(
        steps.filter("open > 1").join(cyclic.select(F.col("node").alias("src")), "src", "left_anti").join(ends, "src", "left")
        .groupBy(F.coalesce("root", "src").alias("src"), F.col("dst").alias("node"))
        .agg(F.count("*").alias("ways"), F.max(F.coalesce("dist", F.lit(0)) + 1).alias("length")))
    merged, _ = _peel(links, rest.filter("open > 1"), known)
    on_chains = chained.join(known.unionByName(merged).select(F.col("node").alias("root"), F.col("layer").alias("above")), "root") \
        .select("node", (F.col("above") + F.col("dist")).alias("layer"))
    return merged.unionByName(on_chains)


def graph_endpoints(edges: DataFrame) -> DataFrame:
    """Entry nodes (no predecessor) and exit nodes (no successor)."""
    src = edges.select(F.col("src").alias("node")).distinct()
    dst = edges.select(F.col("dst").alias("node")).distinct()
    return src.join(dst, "node", "left_anti").withColumn("endpoint", F.lit("entry")).unionByName(
        dst.join(src, "node", "left_anti").withColumn("endpoint", F.lit("exit")))


def critical_nodes(edges: DataFrame) -> DataFrame:
    return graph_endpoints(edges).select("node").distinct()


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Direct successors and predecessors of the given nodes."""
    down = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.lit("downstream").alias("direction"), F.col("dst").alias("neighbor"))
    up = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.lit("upstream").alias("direction"), F.col("src").alias("neighbor"))
    return down.unionByName(up)


def lift_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between jobs as edges between what the jobs run; both ends must be mapped.

    `edges` has (src, dst), `mapping` has (job, graph).
    """
    a = mapping.select(F.col("job").alias("src"), F.col("graph").alias("source_graph"))
    b = mapping.select(F.col("job").alias("dst"), F.col("graph").alias("target_graph"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "source_graph", "target_graph")


FACT = ["workflow", "direction", "dataset"]


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct facts with the least number of levels that they came up. Nulls are not alike: a fact with one stays apart per level."""
    blank = F.col("workflow").isNull() | F.col("direction").isNull() | F.col("dataset").isNull()
    return rows.groupBy(*FACT, F.when(blank, F.col("level")).alias("apart")).agg(F.min("level").alias("level"))


def _moved(facts: DataFrame, links: DataFrame) -> DataFrame:
    return facts.join(links, facts["workflow"] == links["child"]).select(
        F.col("parent").alias("workflow"), "direction", "dataset", (F.col("level") + 1).alias("level"), F.col("above").alias("layer"))


def nested_io(parents: DataFrame, io: DataFrame) -> DataFrame:
    """Inputs and outputs of nested workflows added to every workflow above them.

    `parents` has (parent, child), `io` has (workflow, direction, dataset). Each fact is kept once per workflow.
    All that is nested in a workflow lies in lower layers, so layer by layer its facts are whole, and made
    distinct, before they move up: a fact moves once along a link and meets the facts of its layer only. Facts wait in a
    folder per layer. Workflows on a cycle or above one have no layer; they come last, level by level.
    """
    spark = parents.sparkSession
    folder = f"{shared_folder(spark)}/nested-{uuid.uuid4().hex}"
    pairs = cut_lineage(parents.filter("child IS NOT NULL").select("parent", "child").distinct())
    layers = cut_lineage(topo_layers(pairs.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
                         .select(F.col("node").alias("workflow"), F.coalesce("layer", F.lit(-1)).alias("layer")).filter("workflow IS NOT NULL"))
    of = lambda name, layer: layers.select(F.col("workflow").alias(name), F.col("layer").alias(layer))
    links = cut_lineage(pairs.join(of("child", "below"), "child").join(of("parent", "above"), "parent", "left")
                        .select("parent", "child", "below", F.coalesce("above", F.lit(0)).alias("above")).sort("below", "child"))
    own = io.select(*FACT).distinct().join(layers, "workflow", "left").select(
        *FACT, F.lit(0).alias("level"), F.coalesce("layer", F.lit(0)).alias("layer"))  # those in no link move nowhere
    own.repartitionByRange("layer", "workflow").write.partitionBy("layer").parquet(f"{folder}/step=-1")
    stored = lambda places: spark.read.schema(own.schema).option("basePath", folder).parquet(places).select(own.columns)
    top = layers.agg(F.max("layer")).first()[0]
    for layer in range(0 if top is None else top + 1):
        try:
            facts = _facts(stored(f"{folder}/step=*/layer={layer}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # no facts in this layer
        _moved(facts, links.filter(F.col("below") == layer)).write.partitionBy("layer").parquet(f"{folder}/step={layer}")
    known = stored(folder)
    rest = links.filter("below = -1")
    whole = _facts(known.filter("layer >= 0")).select(*FACT)
    if layers.filter("layer = -1").isEmpty():
        return whole
    new = met = cut_lineage(known.filter("layer = -1").select(*FACT).distinct())
    while not new.isEmpty():
        moved = new.join(rest, new["workflow"] == rest["child"]).select(F.col("parent").alias("workflow"), "direction", "dataset")
        new = cut_lineage(moved.subtract(met))
        met = met.unionByName(new)
    return whole.unionByName(met)


def job_flow(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entry jobs, jobs, dependencies and jobs that run a graph.

    `jobs` has (job, graph), `edges` has (src, dst).
    """
    entry = jobs.join(edges.select(F.col("dst").alias("job")).distinct(), "job", "left_anti")
    # three aggregates of one row each
    return entry.agg(F.count("*").alias("entry_jobs")) \
        .crossJoin(jobs.agg(F.count("*").alias("total_jobs"), F.count("graph").alias("graph_jobs"))) \
        .crossJoin(edges.agg(F.count("*").alias("total_dependencies")))
