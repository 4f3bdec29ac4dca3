"""Questions, document structure, searchable text, metadata filters, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.text import as_col, contains_any, find_many, words


def normalized_terms(text, corrections=None) -> Column:
    """Known misspellings replaced, in lower and in title case, when the text contains them."""
    out = as_col(text)
    title = lambda s: " ".join(w.capitalize() for w in s.split(" "))
    low = F.lower(as_col(text))
    for wrong, right in (corrections or vocab.TERM_CORRECTIONS).items():
        fixed = F.replace(F.replace(out, F.lit(wrong), F.lit(right)), F.lit(title(wrong)), F.lit(title(right)))
        out = F.when(low.contains(wrong), fixed).otherwise(out)
    return out


def normalize_terms(df: DataFrame, text="question", corrections=None) -> DataFrame:
    return df.withColumn(text, normalized_terms(text, corrections))


WORDS_OF_ALL_LANGUAGES = "(?U)"  # questions are prose: letters with accents belong to words


def has_pattern(text, pattern: str) -> Column:
    return as_col(text).rlike(WORDS_OF_ALL_LANGUAGES + pattern)


def question_systems(text) -> Column:
    return F.array_compact(F.array(*[F.when(has_pattern(text, p), s) for s, p in vocab.QUESTION_SYSTEMS.items()]))


def question_entities(text) -> Column:
    patterns = [WORDS_OF_ALL_LANGUAGES + p for p in vocab.QUESTION_ENTITY_PATTERNS]
    return F.array_sort(F.array_distinct(find_many(text, patterns)))


def question_keywords(text) -> Column:
    low = F.lower(as_col(text))
    pick = lambda ws: F.filter(words(ws), lambda w: low.contains(w))
    return F.concat(pick(vocab.COMPARISON_WORDS), pick(vocab.LINEAGE_WORDS))


def classify_questions(df: DataFrame, text="question") -> DataFrame:
    """Intent, confidence, entities, systems and keywords of each question.

    Ordered phrase rules come first; otherwise the intent with most matching patterns wins
    (the earlier intent on ties), and a question without any match is `simple_rag`.
    """
    low = F.lower(F.col(text))
    df = df.withColumn("systems", question_systems(text)).withColumn("entities", question_entities(text)) \
           .withColumn("keywords", question_keywords(text))
    compare = (F.size("systems") >= 2) & contains_any(low, vocab.COMPARISON_WORDS)
    rules = [(contains_any(low, phrases), intent, conf) for intent, conf, phrases in vocab.INTENT_OVERRIDES]
    rules.insert(2, (compare, "comparison", 0.95))
    scores = F.array(*[
        F.struct(sum((has_pattern(low, p).cast("int") for p in patterns), F.lit(0)).alias("score"),
                 F.lit(-i).alias("order"), F.lit(intent).alias("intent"))
        for i, (intent, patterns) in enumerate(vocab.INTENT_PATTERNS.items())])
    df = df.withColumn("_best", F.array_max(scores))
    scored = F.col("_best.score") > 0
    intent = F.when(scored, F.col("_best.intent")).otherwise("simple_rag")
    confidence = F.when(scored, 0.70).otherwise(0.60)
    for cond, name, conf in reversed(rules):
        intent = F.when(cond, name).otherwise(intent)
        confidence = F.when(cond, conf).otherwise(confidence)
    return df.withColumn("intent", intent).withColumn("confidence", confidence).drop("_best")


def detect_structure(meta: DataFrame, sheet="sheet", columns="columns") -> DataFrame:
    """Kind of a sheet from its name and column names."""
    name = F.lower(F.col(sheet))
    cols = F.array_join(F.transform(F.col(columns), lambda c: F.lower(c)), " ")
    by_name, by_cols = contains_any(name, vocab.COMPARISON_SHEET_WORDS), contains_any(cols, vocab.COMPARISON_COLUMN_WORDS)
    is_map, is_sttm = contains_any(name, vocab.MAPPING_SHEET_WORDS), contains_any(name, vocab.STTM_SHEET_WORDS)
    kind = (F.when(is_sttm, "sttm_sheet").when(by_name | by_cols, "comparison_sheet")
            .when(is_map, "mapping_table").otherwise("unknown"))
    conf = (F.when(is_sttm | by_name, "high").when(is_map & ~by_cols, "medium").otherwise("low"))
    return meta.withColumn("detected_type", kind).withColumn("is_comparison", by_name | by_cols) \
        .withColumn("is_mapping", is_map).withColumn("is_sttm", is_sttm).withColumn("confidence", conf)


def detect_json_structure(meta: DataFrame, keys="keys") -> DataFrame:
    has = lambda *ks: F.arrays_overlap(F.col(keys), words(ks))
    return meta.withColumn("is_workflow_mapping", has("mappings", "workflow_mappings")) \
        .withColumn("is_notebook_analysis", has("pipelines", "notebooks")) \
        .withColumn("is_validation_report", has("gaps", "validation", "report"))


# --- Fixed values: lines of the searchable texts (label, column) ----------------------
DOCUMENT_LINES = {
    "process": [("Process", "name"), ("System", "system"), ("Type", "process_type"), ("Description", "description"),
                ("Business Function", "business_function"), ("File Path", "path")],
    "component": [("Component", "name"), ("Type", "component_type"), ("System", "system"), ("Process", "process_id"),
                  ("Description", "description")],
    "sttm": [("STTM Mapping", "mapping_id"), ("Source Column", "source_column"), ("Source Table", "source_table"),
             ("Source System", "source_system"), ("Target Column", "target_column"), ("Target Table", "target_table"),
             ("Target System", "target_system"), ("Transformation", "rule")],
    "gap": [("Gap", "gap_type"), ("Name", "name"), ("Description", "description"), ("Severity", "severity"),
            ("Source System", "source_system"), ("Target System", "target_system"), ("Impact", "impact"),
            ("Recommendation", "recommendation")],
    "transformation": [("Transformation", "kind"), ("Code", "snippet"), ("Condition", "condition")],
    "lineage": [("Lineage", "lineage_kind"), ("Source", "source_column"), ("Target", "target_column")],
}

# --- Fixed values: keys of the metadata (key, column) ---------------------------------
DOCUMENT_METADATA = {
    "process": [("name", "name"), ("system", "system"), ("process_type", "process_type"), ("file_path", "path"),
                ("business_function", "business_function"), ("component_count", "component_count")],
    "component": [("name", "name"), ("system", "system"), ("component_type", "component_type"), ("process_name", "process_name"),
                  ("process_id", "process_id"), ("file_path", "path")],
    "sttm": [("source_system", "source_system"), ("target_system", "target_system"), ("source_table", "source_table"),
             ("target_table", "target_table")],
    "gap": [("name", "name"), ("gap_type", "gap_type"), ("severity", "severity"), ("source_system", "source_system"),
            ("target_system", "target_system")],
}


def document_metadata(df: DataFrame, kind: str) -> Column:
    """Map of what a document can be filtered by (`where_meta`); columns that are missing or null give ''."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    entries = [("doc_type", F.lit(kind))] + [(k, value(c)) for k, c in DOCUMENT_METADATA.get(kind, [])]
    if kind == "sttm":
        entries.append(("name", F.concat(value("source_column"), F.lit(" → "), value("target_column"))))
    return F.create_map(*[x for k, v in entries for x in (F.lit(k), v)])


def to_documents(df: DataFrame, kind: str, key: str, max_items: int | None = None, max_chars: int | None = None,
                 max_params: int | None = None, metadata: bool = False) -> DataFrame:
    """Searchable document (id, doc_type, content, and the map `metadata` if asked for) per row of facts.

    Datasets, parameters and logic are added when the columns exist; None: whole, else cut to the caps.
    """
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(
        F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A")) if c in df.columns else F.lit("N/A"))
    first = lambda c, n: c if n is None else F.slice(c, 1, n)
    parts = [line(label, c) for label, c in DOCUMENT_LINES[kind]]
    if kind == "sttm":
        plain = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A")) if c in df.columns else F.lit("N/A")
        parts.append(F.concat(F.lit("Data Type: "), plain("source_type"), F.lit(" → "), plain("target_type")))
    if "parameters" in df.columns:
        shown = F.transform(first(F.map_entries("parameters"), max_params),
                            lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
        parts.append(F.when(F.size("parameters") > 0, F.concat(F.lit("\nParameters:\n"), F.array_join(shown, "\n"))))
    if "component_count" in df.columns:
        parts.append(F.concat(F.lit("\nComponents: "), F.col("component_count").cast("string"), F.lit(" components")))
    for column, label in (("input_datasets", "\nInput Datasets"), ("output_datasets", "Output Datasets")):
        if column in df.columns:
            parts.append(F.when(F.size(column) > 0, F.concat(
                F.lit(f"{label}: "), F.array_join(first(F.col(column), max_items), ", "))))
    if "logic" in df.columns:
        parts.append(F.when(F.col("logic") != "", F.concat(
            F.lit("\nTransformation Logic:\n"), F.col("logic") if max_chars is None else F.left("logic", F.lit(max_chars)))))
    more = [document_metadata(df, kind).alias("metadata")] if metadata else []
    return df.select(F.col(key).alias("id"), F.lit(kind).alias("doc_type"), F.concat_ws("\n", *parts).alias("content"), *more)


def process_question(name) -> Column:
    return F.concat(F.lit("What does the process '"), as_col(name), F.lit("' do?"))


def sttm_question(source_table=None, target_table=None, column=None) -> Column:
    """Question for mappings; parts whose value is null, empty or not given are left out."""
    said = lambda words_, v: F.lit(None) if v is None else F.concat(F.lit(words_), F.nullif(as_col(v), F.lit("")))
    return F.concat_ws(" ", F.lit("Show me source-to-target mappings"), said("from source table ", source_table),
                       said("to target table ", target_table), said("for column ", column))


def gap_question(source_system=None, target_system=None) -> Column:
    """Question for gaps; the target counts only beside a source."""
    none = F.lit(None).cast("string")
    source, target = (none if v is None else F.nullif(as_col(v), F.lit("")) for v in (source_system, target_system))
    where = F.when(target.isNotNull(), F.concat(F.lit(" between "), source, F.lit(" and "), target)).otherwise(F.concat(F.lit(" in "), source))
    return F.concat(F.lit("What gaps exist"), F.coalesce(where, F.lit("")), F.lit("?"))


def where_meta(docs: DataFrame, wanted: dict) -> DataFrame:
    """Documents whose columns, or entries of the map `metadata`, equal all wanted values."""
    for k, v in wanted.items():
        value = F.col(k) if k in docs.columns else F.try_element_at("metadata", F.lit(k))
        docs = docs.filter(value == v)
    return docs


def where_any(docs: DataFrame, types=None, systems=None, type_column="doc_type", system_column="system") -> DataFrame:
    """Any of the types AND any of the systems; an empty list does not filter."""
    if types:
        docs = docs.filter(F.col(type_column).isin(*types))
    return docs.filter(F.col(system_column).isin(*systems)) if systems else docs


def clean_docs(docs: DataFrame, max_title: int | None = None, max_content: int | None = None) -> DataFrame:
    """Drops rows without id or content; shortens title and content to the lengths given and flags the latter."""
    long = F.lit(False) if max_content is None else F.length("content") > max_content
    title, content = F.coalesce("title", F.lit("")), F.col("content")
    return docs.filter((F.coalesce(F.col("id").cast("string"), F.lit("")) != "") & (F.coalesce("content", F.lit("")) != "")) \
        .withColumn("title", title if max_title is None else F.left(title, F.lit(max_title))) \
        .withColumn("truncated", long) \
        .withColumn("content", content if max_content is None else F.when(long, F.left("content", F.lit(max_content))).otherwise(content))


def stem_of_graph(name) -> Column:
    return F.regexp_replace(as_col(name), r"\.(mp|plan|pset)", "")


def include_graphs(files: DataFrame, included: DataFrame, name="name") -> DataFrame:
    """Files whose graph name (without extension) is on the list, with its module."""
    return files.withColumn("graph", stem_of_graph(name)).join(included, "graph", "inner")


def module_of(files: DataFrame, included: DataFrame, name="name") -> DataFrame:
    """All files with the module of their graph, `Unknown` when not listed."""
    return files.withColumn("graph", stem_of_graph(name)).join(included, "graph", "left") \
        .withColumn("module", F.coalesce("module", F.lit("Unknown")))


def upsert_docs(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row per key by version; an aggregate with partial results, no window."""
    rows = old.unionByName(new)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("_row")).select(key, "_row.*")
