"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions.scale import cut_lineage

stage = cut_lineage

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: columns that a table has besides cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def per_batch(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


HOT = 1000  # keys with more than one in so many of all rows are hot; there are fewer than this


def meet(rows: DataFrame, counted: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` with the columns of `counted`, one row per key with a count `n` of the rows that have it, of `total`.

    Hot keys meet theirs by a broadcast of fewer than HOT rows, so their rows stay where they are;
    the others are shuffled.
    """
    values = [c for c in counted.columns if c not in (*keys, "n")]
    hot = counted.where(F.col("n") * HOT > total).select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.struct(*values).alias("hot"))
    found = rows.join(F.broadcast(hot), reduce(and_, [F.col(k) == F.col(f"hot_{k}") for k in keys]), "left")
    others = found.where("hot is null").select(rows.columns).join(counted.drop("n"), keys).select(*rows.columns, *values)
    return found.where("hot is not null").select(*rows.columns, "hot.*").union(others)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small ones, where a row's results take many times its own room in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def runs(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in runs of about `size` bytes that end before ASCII white space."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end]
        at = end


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 well-spread bits of 64-bit numbers (the finishing steps of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
