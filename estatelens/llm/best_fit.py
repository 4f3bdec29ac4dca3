"""Operator 13: best-fit packing in rounds, where bins that are not nearly full are merged as items."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import documents, per_batch, read, sliced, stage
from estatelens.llm.packing import encoder, vocabulary

CAPACITY = 1024
END = 2  # id after each document
NODE = 100_000  # pieces that one node of the tree packs
WASTE = 1 / 128  # share of the capacity that a nearly full bin leaves empty at most
GAIN = 0.005  # a round that saves a smaller share of its bins is the last

_PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BINS = f"fill long, pieces array<{_PIECE}>"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents whole, or if longer in pieces of `capacity`, the first one being the shorter."""
    def run(batches):
        encode = encoder(path)
        end = np.array([END], np.uint32)
        for batch in sliced(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4")
                stops = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for piece, stop in enumerate(stops):
                    start = max(stop - capacity, 0) if piece else 0
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return per_batch(documents(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: the longest items first, each into the fullest bin with room for it.

    Open bins are stacked by room; a bit per room tells which stacks hold any.
    """
    place = np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := open_rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        place[i] = at
        if left := room - size:
            rooms[left].append(at)
            open_rooms |= 1 << left
    return place


def merged(table: pa.Table, capacity: int) -> pa.Table:
    """The bins of a node packed into bins, with each piece's place in its new bin."""
    table = table.combine_chunks()
    lists = table.column("pieces").combine_chunks() if table.num_rows else pa.array([], table.schema.field("pieces").type)
    fills = table.column("fill").to_numpy()
    place = best_fit(fills, capacity)
    owner = np.repeat(place, np.diff(lists.offsets.to_numpy()))
    order = np.argsort(owner, kind="stable")
    held = lists.flatten().take(pa.array(order))
    length = held.field("length").to_numpy()
    edges = np.searchsorted(owner[order], np.arange(place.max(initial=-1) + 2))
    before = np.concatenate([[0], np.cumsum(length)])
    offset = before[:-1] - np.repeat(before[edges[:-1]], np.diff(edges))
    names = [held.type.field(k).name for k in range(held.type.num_fields)]
    fields = [pa.array(offset, pa.int64()) if n == "offset" else held.field(n) for n in names]
    new = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names))
    return pa.table({"fill": pa.array(before[edges[1:]] - before[edges[:-1]], pa.int64()), "pieces": new})


def one_round(bins: DataFrame, nodes: int, capacity: int) -> DataFrame:
    """Bins dealt evenly to nodes whatever they hold (repeated rows too), and packed best-fit in each."""
    dealt = bins.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nodes)).alias("node"), "fill", "pieces")
    return stage(dealt.groupBy("node").applyInArrow(lambda t: merged(t.select(["fill", "pieces"]), capacity), BINS))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, node: int = NODE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Full pieces are sequences. The others are dealt to nodes of about `node` pieces, which pack them
    best-fit; nearly full bins are done, the others are the items of the next round, on as many nodes as
    they fill. It ends with the round of one node, or when a round saves next to nothing, since bins over
    half full then have no partners. A node holds narrow rows only, and each round is a table in the
    shared folder. A null text is empty: its one id is END. Every row is a document of its own, repeated ones
    and those without doc_id too; other columns are ignored; without documents there are no pieces.
    """
    cut = stage(pieces(docs, path, capacity))
    single = lambda df: df.select(F.col("length").alias("fill"), F.array(F.struct(*cut.columns, F.lit(0).cast("bigint").alias("offset"))).cast(f"array<{_PIECE}>").alias("pieces"))
    done, items = [single(cut.where(F.col("length") == capacity))], single(cut.where(F.col("length") < capacity))
    least = capacity - int(capacity * WASTE)
    while True:
        held = items.agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("pieces")).first()
        nodes = -(-held["pieces"] // node)
        if not nodes:
            break
        bins = one_round(items, nodes, capacity)
        left = bins.where(F.col("fill") < least)
        count = left.count()
        ends = nodes == 1 or not count or bins.count() > (1 - GAIN) * held["bins"]
        done.append(bins if ends else bins.where(F.col("fill") >= least))
        if ends:
            break
        items = left
    every = done[0]
    for bins in done[1:]:
        every = every.unionByName(bins)
    return every.select("pieces", F.monotonically_increasing_id().alias("sequence_id")).select("sequence_id", F.inline("pieces")) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of at most 1024 byte-level BPE ids over all documents, of which only longer ones are cut."""
    return pack(read(spark, folder, "documents"), vocabulary())
