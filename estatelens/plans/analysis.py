"""End-to-end jobs: each takes input tables and returns its result tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage
from estatelens.operators import documents, gaps, lineage, matching, search, sttm, workflow_mapping
from estatelens.operators.scripts import classify_scripts, script_locations

GAP_COLUMNS = ["gap_id", "gap_type", "severity"]


def compare_estates(processes: DataFrame, components: DataFrame, source: str, target: str,
                    threshold: float = vocab.PROCESS_THRESHOLD, pairs: DataFrame | None = None,
                    matched: DataFrame | None = None) -> dict[str, DataFrame]:
    """Match processes of two systems, then find gaps and cross-system column mappings.

    `processes`: process_id, system, name, business_function. `components`: component_id,
    process_id, name, component_type, input_dataset, output_dataset, in_fields, out_fields.
    Known `pairs` (source_process, target_process) replace the matching step. Source processes outside `matched`
    (process_id), or without it outside the pairs, are missing.
    """
    processes = processes.drop("path")
    if pairs is None:
        best = matching.match_processes(processes, components, source, target, threshold)
        pairs = best.select(F.col("source_id").alias("source_process"), F.col("target_id").alias("target_process"))
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.col("source_process").alias("source_id"), F.col("target_process").alias("target_id"))
    by_process = components.withColumn("id", F.col("process_id"))
    tables = by_process.select("id", F.explode(F.array("input_dataset", "output_dataset")).alias("item"))
    columns = by_process.select("id", F.explode("out_fields").alias("f")).select("id", F.col("f.name").alias("item"))
    matched_ids = pairs.select(F.col("source_process").alias("process_id")) if matched is None else matched
    found = [
        gaps.missing(processes.filter(F.col("system") == source), matched_ids, "process_id"),
        gaps.count_mismatch(ids, by_process, by_process),
        gaps.missing_items(ids, tables, tables, "data_coverage"),
        gaps.missing_items(ids, columns, columns, "missing_columns"),
    ]
    all_gaps = found[0].select(*GAP_COLUMNS)
    for g in found[1:]:
        all_gaps = all_gaps.unionByName(g.select(*GAP_COLUMNS))
    linked = components.withColumn("inputs", F.array("input_dataset")).withColumn("outputs", F.array("output_dataset"))
    return {"pairs": pairs, "gaps": all_gaps.distinct(),
            "mappings": sttm.cross_process_classes(pairs, linked, linked)}


def validate_migration(scripts: DataFrame, source: str, target: str, threshold: float = vocab.PAIR_THRESHOLD) -> dict[str, DataFrame]:
    """Signatures, workflow mappings, completeness report, gaps and recommendations."""
    sigs = cut_lineage(workflow_mapping.signatures(scripts))
    maps = workflow_mapping.group_mappings(sigs, source, target, threshold)
    report = workflow_mapping.migration_report(maps, sigs, source, target)
    found = workflow_mapping.migration_gaps(maps, sigs, source, target)
    critical = found.agg(F.count_if(F.col("severity") == "critical").alias("n"))
    lost = maps.missing_tables()
    missing = lost.agg(F.count("*").alias("n"))
    return {"signatures": sigs, "mappings": workflow_mapping.mapping_table(maps, sigs, source, target),
            "table_diff": maps.table_diff(), "table_counts": maps.table_counts(), "missing_tables": lost, "report": report, "gaps": found,
            "recommendations": workflow_mapping.migration_recommendations(report, critical, missing)}


def answer_context(questions: DataFrame, docs: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Intent of each question and the context found for it in the systems it names.

    `questions`: query_id, question, vector. `docs`: id, vector, system, doc_type, content.
    A question that names no system searches all of them.
    """
    asked = cut_lineage(documents.classify_questions(documents.normalize_terms(questions)))
    hits = search.multi_search(docs, asked, k, "system")
    wanted = asked.select("query_id", "systems")
    hits = hits.join(wanted, "query_id").filter((F.size("systems") == 0) | F.array_contains("systems", F.col("system")))
    hits = search.topk_per_group(hits.drop("rank", "systems", "system"), k, ["query_id"], ["distance", "id"])
    context = search.build_context(hits.join(docs.select("id", "doc_type", "system", "content"), "id"), k)
    return {"questions": asked, "hits": hits, "context": context}


def analyze_lineage(files: DataFrame, script: str = "path") -> dict[str, DataFrame]:
    """Script classes, the location graph, its nodes and its entry and exit locations."""
    locations = script_locations(files).withColumn("script", F.col(script))
    edges = cut_lineage(lineage.lineage_graph(locations))
    ends = lineage.graph_endpoints(edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    return {"scripts": classify_scripts(files), "edges": edges, "nodes": lineage.graph_nodes(edges),
            "endpoints": ends.filter(~F.col("node").startswith("script:"))}
