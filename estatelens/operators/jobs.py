"""Job files of the scheduler: sniffing, job blocks, dependencies, graphs run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.matches import explode_structs, group, matches
from estatelens.functions.text import NEWLINE, as_col, extension, file_name, words

# --- Fixed values: patterns on job text ------------------------------------------
BLOCK_START = r"(?=(?:insert_job|update_job):)"
JOB_NAME = r"(?:insert_job|update_job):\s*([^\s]+)"
KEY_VALUE = r"^([a-z_]+):\s*(.+)"
SHORT_CONDITION = r"(?i)\b([sfdrntp])\(([^)]+)\)"
LONG_CONDITION = r"(?i)\b(success|done|failure|running|terminated|notrunning)\(([^)]+)\)"


SNIFF_LINES = 20  # fixed value: lines of a file that tell its format


def keyword_hits(content, keywords=None, n_lines: int = SNIFF_LINES) -> Column:
    """How many keywords occur in the first lines of a text."""
    head = F.lower(F.array_join(F.slice(F.split(as_col(content), NEWLINE), 1, n_lines), NEWLINE))
    return F.size(F.filter(words(keywords or vocab.JIL_KEYWORDS), lambda k: head.contains(k)))


def sniff_format(files: DataFrame, keywords=None, n_lines: int = SNIFF_LINES, min_hits: int = 2) -> DataFrame:
    """Files whose first lines show at least `min_hits` keywords."""
    return files.withColumn("hits", keyword_hits("content", keywords, n_lines)).filter(F.col("hits") >= min_hits)


def job_files(files: DataFrame) -> DataFrame:
    """Job files by extension, or by content where a file has none or an upper-case one."""
    name = file_name("path")
    last = F.element_at(F.split(name, r"\."), -1)
    unclear = ~name.contains(".") | ((F.upper(last) == last) & (F.lower(last) != last))
    return files.filter((extension("path") == ".jil") | (unclear & (keyword_hits("content") >= 2)))


def jil_jobs(files: DataFrame) -> DataFrame:
    """One row per job block with its name and key/value map (the last value of a key wins)."""
    keep = [c for c in files.columns if c != "content"]
    blocks = files.select(*keep, F.posexplode(F.split("content", BLOCK_START)).alias("block_no", "block"))
    lines = F.split("block", NEWLINE)
    pairs = F.transform(
        F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda l: F.trim(l)),
                 lambda l: l.rlike(KEY_VALUE)),
        lambda l: F.struct(group(l, KEY_VALUE, 1).alias("key"),
                           F.regexp_replace(F.trim(group(l, KEY_VALUE, 2)), r'^"+|"+$', "").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    rows = blocks.withColumn("job_name", F.regexp_extract(F.trim(lines.getItem(0)), JOB_NAME, 1)) \
        .filter(F.col("job_name") != "").withColumn("attributes", F.map_from_entries(last))
    attr = lambda k: F.try_element_at(F.col("attributes"), F.lit(k))
    return rows.select(*keep, "block_no", "job_name", "attributes",
                       *[attr(k).alias(k) for k in ("job_type", "command", "machine", "condition", "description")])


def job_dependencies(jobs: DataFrame) -> DataFrame:
    """Edges from the jobs named in a condition, short form first, else the long form."""
    def edge(m, pattern, kind):
        return F.struct(F.trim(group(m, pattern, 2)).alias("source_job"), kind(F.lower(group(m, pattern, 1))).alias("condition_type"))

    codes = F.create_map(*[F.lit(x) for kv in vocab.CONDITION_CODES.items() for x in kv])
    short = F.transform(matches("condition", SHORT_CONDITION), lambda m: edge(m, SHORT_CONDITION, lambda k: codes[k]))
    long = F.transform(matches("condition", LONG_CONDITION), lambda m: edge(m, LONG_CONDITION, lambda k: k))
    rows = jobs.filter(F.col("condition").isNotNull()).select("job_name", "condition")
    out = explode_structs(rows, F.when(F.size(short) > 0, short).otherwise(long), drop=())
    return out.select("source_job", F.col("job_name").alias("target_job"), "condition_type", F.col("condition").alias("condition_full"))


def graph_from_command(command) -> Column:
    """Graph name in a command by the first pattern that fits, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(as_col(command), p, 1), F.lit("")) for p in vocab.GRAPH_COMMAND_PATTERNS])


def job_graphs(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("graph", graph_from_command("command"))
