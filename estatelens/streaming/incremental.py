"""Incremental indexing: new and changed files by their state, idempotent batches, failed files."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_BATCH = 1000


def file_key(path="path", size="size", modified="modified"):
    """Key of a file's state, without reading it."""
    return F.md5(F.concat_ws("_", F.col(path), F.col(size).cast("string"), F.col(modified).cast("string")))


def changed_files(previous: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are new or changed since the previous scan; both have the column `file_key`."""
    return now.join(previous.select("file_key").distinct(), "file_key", "left_anti")


def _written() -> Column:
    """When a row was written: runs over files are named by time; batches of a stream come before them, in their own order."""
    timed = F.col("run").rlike("^[0-9]{20}-")
    return F.struct(F.when(timed, F.substring("run", 1, 20)).otherwise("").alias("at"), F.when(timed, F.lit(None)).otherwise(F.col("version")).alias("version"), F.col("run").alias("run"))


def latest_states(rows: DataFrame) -> DataFrame:
    """(id, file_key) of the newest run per file: an older state that comes back is a change."""
    return rows.groupBy("id").agg(F.max_by("file_key", _written()).alias("file_key"))


def _write(rows: DataFrame, out: str, run: str) -> None:
    """One pass: every row is kept whole, tagged good or not, below a folder of its run.

    A row is good if it has an id and content. The keys of a run are in its rows, so they are
    committed with it.
    """
    good = (F.coalesce(F.col("id").cast("string"), F.lit("")) != "") & (F.coalesce("content", F.lit("")) != "")
    rows.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("good", good.cast("int")) \
        .write.mode("overwrite").partitionBy("good").parquet(f"{out}/run={run}")


def stored(spark: SparkSession, out: str) -> DataFrame | None:
    """All rows of all runs, or None before the first one."""
    try:
        return spark.read.parquet(out)
    except AnalysisException:
        return None


def index_changes(files: DataFrame, out: str) -> None:
    """Indexes the files whose state (`file_key`) is not the one that the newest run stored, whatever their age.

    `files` has (id, title, content, version, file_key).
    """
    known = stored(files.sparkSession, out)
    new = files if known is None else changed_files(latest_states(known), files)
    _write(new, out, f"{time.time_ns():020d}-{uuid.uuid4().hex}")


def index_folder(spark: SparkSession, folder: str, glob: str, out: str) -> None:
    """Indexes new and changed files below a folder; only these are read.

    Their paths are a part of the listing that the driver holds for any scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    now = scan.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).withColumn("file_key", file_key())
    known = stored(spark, out)
    paths = [r["path"] for r in (now if known is None else changed_files(latest_states(known), now)).select("path").toLocalIterator()]
    if paths:
        keyed = scan.load(paths).withColumn("file_key", file_key("path", "length", "modificationTime"))
        _write(_as_documents(keyed, "file_key"), out, f"{time.time_ns():020d}-{uuid.uuid4().hex}")


def _as_documents(files: DataFrame, *more: str) -> DataFrame:
    return files.select(F.md5("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("title"),
                        F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("version"), *more)


def index_batch(out: str):
    """Writer for one batch of a stream.

    Its folder is named by the stream's own id, which its checkpoint keeps, and the batch: a repeated
    batch overwrites itself, and a stream that lost its checkpoint writes beside earlier ones.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        _write(batch, out, f"{stream}-{batch_id:010d}")
    return write


def incremental_index(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Indexes all files that are new since the last run, then stops.

    `stream` has (id, title, content, version). Progress lives in the stream's checkpoint: a killed run
    goes on with the batch it lost. A file source knows paths only, so it serves folders whose files
    never change; `index_changes` and `index_folder` follow changed files too.
    """
    query = (stream.writeStream.foreachBatch(index_batch(out)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def parquet_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def script_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream of whole files below a folder as documents."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder))
    return _as_documents(files)


def indexed_docs(spark: SparkSession, out: str) -> DataFrame:
    """The good text of the newest run per document, so a restored file is old again; the winner is chosen without its text.

    Batches of a stream, whose names do not tell their time, go by version.
    """
    rows = spark.read.parquet(out).where("good = 1")
    last = rows.groupBy("id").agg(F.max(F.struct(_written().alias("written"), "version")).alias("last"))
    last = last.select("id", F.col("last.version").alias("version"), F.col("last.written.run").alias("run"))
    return rows.join(last, ["id", "version", "run"]).drop("good", "run", "file_key").dropDuplicates(["id"])


def failed_docs(spark: SparkSession, out: str) -> DataFrame:
    """Rows without id or content, of all runs."""
    return spark.read.parquet(out).where("good = 0").select("id", "title")


def retry_failed(files: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """The files on the failed list that still exist."""
    return files.join(failed.select(key).distinct(), key, "left_semi")
