"""Helpers that keep work spread over many tasks: cut lineage, number rows, carry values."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.functions.text import as_col


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local session (tests) may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="estatelens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back.

    The rows are computed once, survive the loss of any executor, and later steps read only
    the columns they need. (A checkpoint would compute the rows twice and keep them opaque.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.parquet(path)
    _let_go(spark, time.monotonic() - began)
    return spark.read.schema(df.schema).parquet(path)


LONG_S = 10  # a write that took longer is taken to have moved many rows


def _let_go(spark: SparkSession, seconds: float) -> None:
    """Lets Spark delete the shuffle files of a finished write. It does so once the driver has collected the objects that
    name them, and a driver with little to do may not collect any for half an hour, while the files of all steps add up."""
    if seconds > LONG_S:
        spark.sparkContext._jvm.System.gc()


def cut_lineage_by(df: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """`cut_lineage` of the distinct rows, which lie in buckets of `key`, so that joins by it do not move them again."""
    spark, name, n = df.sparkSession, f"stage_{uuid.uuid4().hex}", tasks_for(df, rows)
    began = time.monotonic()
    df.repartition(n, key).distinct().write.format("parquet").bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    _let_go(spark, time.monotonic() - began)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small scan dealt out over all cores, ahead of costly work per row.

    A scan with at least as many splits as cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_pairs(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out ahead of costly work: few bytes would end up in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by hash of `keys` to tasks of about `rows` rows, so that what a task sorts or holds does not grow with the input.

    The rows are counted first, so they should be cheap to read twice.
    """
    return df.repartition(tasks_for(df, rows), *keys)


def ranged(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by ranges of `keys` to tasks of about `rows` rows. What is made of them, such as exploded rows, and
    sorted by these keys first is then sorted where it is made, and only these rows move.

    The rows are counted and sampled first, so they should be cheap to read three times.
    """
    return df.repartitionByRange(tasks_for(df, rows), *keys)


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks of about `rows` rows the rows fill, and no fewer than a shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def join_spread(left: DataFrame, right: DataFrame, on: list[str], block: int = 1024) -> DataFrame:
    """Inner join on keys that very many rows of both sides share, when every pair is asked for.

    A join by key alone leaves all pairs of a key to one task. Here the rows of a key are dealt to blocks of about
    `block` left rows, the right rows come once per block, and blocks are dealt to tasks whatever their few bytes.
    """
    mark = F.xxhash64(*[c for c, t in left.dtypes if "map<" not in t])
    sizes = left.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("bigint").alias("_blocks")).where("_blocks > 1")
    sizes = maybe_broadcast(cut_lineage(sizes))  # most keys have one block
    parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.coalesce("_blocks", F.lit(1).cast("bigint"))
    dealt = left.withColumn("_mark", mark).join(sizes, on, "left").withColumn("_block", F.pmod(F.col("_mark"), blocks))
    again = right.join(sizes, on, "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    keys = [*on, "_block"]
    rows = lambda df, *extra: df.drop("_blocks", *extra).repartition(parts, *keys).hint("merge")
    return rows(dealt, "_mark").join(rows(again), keys).drop("_block")


POSITION_BITS = 33  # low bits of monotonically_increasing_id: position inside a partition


def number_rows(df: DataFrame, order: list, group: list[str] | None = None,
                name: str = "row_number", columns: list[str] | None = None) -> DataFrame:
    """Row numbers 1.. in the given order, per group or over all rows; `columns` (all, if not given) come beside them.

    A plain window would send a whole group to one task. Here rows are range-partitioned
    by (group, order), so a hot group spans many partitions; each row gets its position in
    its partition, and only one small row per (partition, group) is windowed for offsets.
    """
    group, columns = group or [], df.columns if columns is None else columns
    keys = [as_col(c) for c in group] + [as_col(c) for c in order]
    kept = [*columns, *[g for g in group if g not in columns]]
    rows = cut_lineage(df.sort(*keys).select(*kept, F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_part", F.shiftright("_at", POSITION_BITS)) \
               .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
    spans = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p")) \
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    marks = [f"_g{i}" for i in range(len(group))]
    before = Window.partitionBy(*marks).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for g, m in zip(group, marks):
        same = same & F.col(g).eqNullSafe(F.col(m))
    number = F.col("_before") + F.col("_pos") - F.col("_first") + 1
    return rows.join(spans, same).select(*columns, number.cast("bigint").alias(name))


def forward_fill(df: DataFrame, group: list[str], position: str, columns: list[str],
                 span: int = 100_000) -> DataFrame:
    """Last non-null value up to each row, by integer position within a group.

    Long groups are cut into spans of `span` positions: fill inside each span, then carry
    the last value of earlier spans through a window over one row per span.
    """
    cut = df.withColumn("_span", F.floor(F.col(position) / span))
    inside = Window.partitionBy(*group, "_span").orderBy(position)
    filled = cut
    for c in columns:
        filled = filled.withColumn(f"_in_{c}", F.last(c, ignorenulls=True).over(inside))
    lasts = cut.groupBy(*group, "_span").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_end_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *group, "_span",
        *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_from_{c}") for c in columns],
    )
    out = filled.join(carried, [*group, "_span"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_in_{c}"), F.col(f"_from_{c}")))
    return out.select(*df.columns)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True when the DataFrame has at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint only after a count shows that the side is small."""
    return F.broadcast(df) if small_enough(df, rows) else df


def substrings(text, lengths: Column) -> Column:
    """All distinct substrings whose length occurs in `lengths`.

    Turns "a contains b" into an equality join: explode the longer side, match the shorter.
    """
    text = as_col(text)
    n = F.length(text)
    fitting = F.filter(lengths, lambda k: (k > 0) & (k <= n))
    parts = F.transform(
        fitting,
        lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k)),
    )
    return F.array_distinct(F.flatten(parts))
