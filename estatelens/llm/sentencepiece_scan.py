"""Operator 4: SentencePiece encoding and decoding, with giant documents cut into chunks that are encoded apart."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.common import documents, per_batch, read, sliced, stage

CHUNK = 16_384  # code points of a chunk; longer documents are cut
SPACE = "▁"
KNOWN = 100_000  # pairs of neighbours that a task remembers
FRESH = ""  # the last token at a place that no piece can span

State = tuple[int, int]  # of a boundary: start and end of the token that reaches or crosses it


class Model:
    """A BPE model with byte fallback, identity normalisation and a leading space.

    Its encoding of a text is the one path of tokens in which each two neighbours stay as they are when
    encoded by themselves: merges go by score and place, and a merge across two tokens would show up in
    the two alone. So encoding is the only path of weight 0 in a max-plus lattice whose transitions
    weigh 0 for such neighbours and minus infinity for others, and its state is the last token.
    """

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.lib.get_piece_size())
        self.bytes = {int(self.lib.id_to_piece(i)[3:5], 16): i for i in ids if self.lib.is_byte(i)}
        plain = [i for i in ids if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.scores = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.known: dict[tuple[str, str], bool] = {}
        self.letters = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or len(self.bytes) != 256 or "".join(self.lib.encode(" a  b\n", out_type=str)) != f"{SPACE * 2}a{SPACE * 2}b<0x0A>":
            raise ValueError("only byte-fallback models with identity normalisation, a leading space and no piece across words are read")

    def merged(self, text: str) -> list[str]:
        """The encoding of a few characters by the merge rule itself."""
        parts = list(text)
        while True:
            best = max(((self.scores[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.scores), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, last: str, token: str) -> bool:
        """Whether the transition weighs 0."""
        pair = (last, token)
        if pair not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[pair] = self.merged(last + token) == [x for x in pair if x]
        return self.known[pair]

    def id_list(self, token: str) -> list[int]:
        if token in self.ids:
            return [self.ids[token]]
        return [self.bytes[b] for b in token.encode()]

    def words(self, text: str) -> list[int]:
        """Ids of a normalised text that starts with a space: the library adds that one itself."""
        return self.lib.encode(text[1:].replace(SPACE, " "), num_threads=1) if len(text) > 1 else [i for i in self.id_list(text)] if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.letters[i] for i in ids).decode(errors="replace")


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """Places [a, b) of a normalised text of `total` code points; `held` is the text from `at` on, with a margin on both sides."""

    def __init__(self, m: Model, held: str, at: int, a: int, b: int, total: int):
        self.m, self.held, self.at, self.a, self.b, self.total = m, held, at, a, b, total

    def text(self, p: int, q: int) -> str:
        return self.held[p - self.at : q - self.at]

    def sure(self, p: int) -> bool:
        """A place that no piece spans, whatever stands around."""
        return p in (0, self.total) or (self.text(p, p + 1) == SPACE and self.text(p - 1, p) != SPACE)

    def states(self, boundary: int) -> list[State]:
        """All tokens that may reach or cross a boundary."""
        if self.sure(boundary):
            return [(boundary, boundary)]
        found = []
        for q in range(max(0, boundary - self.m.longest), boundary):
            for e in range(boundary, min(self.total, q + self.m.longest) + 1):
                if e == q + 1 or self.text(q, e) in self.m.ids:
                    found.append((q, e))
        return found

    def sure_places(self) -> tuple[int, int] | None:
        """First and last sure place in [a, b), where b counts if it is sure itself."""
        first = next((p for p in range(self.a, self.b) if self.sure(p)), None)
        if first is None:
            return None
        if self.sure(self.b):
            return first, self.b
        return first, next(p for p in range(self.b - 1, self.a - 1, -1) if self.sure(p))

    def _walk(self, begin: dict[int, dict[str, int]], stop: int, back: dict | None = None) -> dict[State, int]:
        """From tokens that end at places, each with a set of entries as bits: the tokens that reach or cross `stop`."""
        m, nodes, out = self.m, begin, {}
        p = min(begin)
        while nodes:
            p = min(nodes)
            here = nodes.pop(p)
            if self.sure(p) and FRESH not in here:
                bits = 0
                for last, own in here.items():
                    bits |= own
                    if back is not None:
                        back.setdefault((p, FRESH), (p, last))
                here = {FRESH: bits}
            for last, own in here.items():
                for size in range(1, min(m.longest, self.total - p) + 1):
                    token = self.text(p, p + size)
                    if (size > 1 and token not in m.ids) or not m.follows(last, token):
                        continue
                    if back is not None:
                        back[p + size, token] = (p, last)
                    if p + size >= stop:
                        out[p, p + size] = out.get((p, p + size), 0) | own
                    else:
                        into = nodes.setdefault(p + size, {})
                        into[token] = into.get(token, 0) | own
        return out

    def _begin(self, entries: list[State]) -> dict[int, dict[str, int]]:
        begin: dict[int, dict[str, int]] = {}
        for k, (q, e) in enumerate(entries):
            begin.setdefault(e, {})[FRESH if q == e or self.sure(e) else self.text(q, e)] = 1 << k
            if self.sure(e):
                begin[e][FRESH] = begin[e].get(FRESH, 0) | 1 << k
        return begin

    def transfer(self) -> list[tuple[State, State]]:
        """The finite entries of the transfer matrix: which boundary state leads to which."""
        entries = self.states(self.a)
        past = [(s, (self.b, self.b) if s[1] == self.b and self.sure(self.b) else s) for s in entries if s[1] >= self.b]
        entries = [s for s in entries if s[1] < self.b]
        if not entries:
            return past
        places = self.sure_places()
        if places is None or places[0] == places[1] == self.b:
            found = self._walk(self._begin(entries), self.b)
            if self.sure(self.b):
                bits = 0
                for own in found.values():
                    bits |= own
                found = {(self.b, self.b): bits}
            return past + [(s, x) for x, own in found.items() for k, s in enumerate(entries) if own >> k & 1]
        first, last = places
        bits = 0
        early = {e: v for e, v in self._begin([s if s[1] < first else (s[0], s[1]) for s in entries]).items() if e < first}
        for k, s in enumerate(entries):
            if s[1] == first:
                bits |= 1 << k
        if early:
            for own in self._walk(early, first).values():
                bits |= own
        exits = [(self.b, self.b)] if last == self.b else list(self._walk({last: {FRESH: 1}}, self.b))
        return past + [(s, x) for k, s in enumerate(entries) if bits >> k & 1 for x in exits]

    def _path(self, start: State, stop: int, end: State) -> list[int]:
        """Ids of the path from a state to the token that is `end`."""
        back: dict = {}
        first = FRESH if self.sure(start[1]) else self.text(*start)
        if start[1] >= stop:
            return []
        self._walk({start[1]: {first: 1}}, stop, back)
        tokens, at = [], (end[1], self.text(*end))
        while at != (start[1], first):
            if at[1]:
                tokens.append(at[1])
            at = back[at]
        return [i for t in reversed(tokens) for i in self.m.id_list(t)]

    def backtrace(self, entry: State, leave: State) -> list[int]:
        """Ids of the tokens between two known states."""
        if entry[1] >= self.b:
            return []
        places = self.sure_places()
        if places is None or places[0] == places[1]:
            if self.sure(self.b):
                leave = next(x for x in self._walk({entry[1]: {FRESH if self.sure(entry[1]) else self.text(*entry): 1}}, self.b) if x[1] == self.b)
            return self._path(entry, self.b, leave)
        first, last = places
        ids = []
        if entry[1] < first:
            begin = {entry[1]: {FRESH if self.sure(entry[1]) else self.text(*entry): 1}}
            ids += self._path(entry, first, next(x for x in self._walk(begin, first) if x[1] == first))
        ids += self.m.words(self.text(first, last))
        return ids if last == self.b else ids + self._path((last, last), self.b, leave)


def product(x: set[tuple[State, State]], y: set[tuple[State, State]]) -> set[tuple[State, State]]:
    """Max-plus product of two transfer matrices, which are their finite entries (all weigh 0)."""
    into: dict[State, list[State]] = {}
    for a, b in y:
        into.setdefault(a, []).append(b)
    return {(a, c) for a, b in x for c in into.get(b, ())}


def boundaries(parts: list[set[tuple[State, State]]], start: State, end: State) -> list[State]:
    """The state at each boundary on the path from start to end: products over halves, as multiplication is associative."""
    if len(parts) == 1:
        return []
    half = len(parts) // 2
    left, right = parts[:half], parts[half:]
    to, back = _all(left, start), _all(right, None, end)
    middle = next(iter({b for _, b in to} & {a for a, _ in back}))
    return [*boundaries(left, start, middle), middle, *boundaries(right, middle, end)]


def _all(parts: list[set[tuple[State, State]]], start: State | None, end: State | None = None) -> set[tuple[State, State]]:
    if len(parts) > 1:
        half = len(parts) // 2
        out = product(_all(parts[:half], start), _all(parts[half:], None, end)) if start or end else product(_all(parts[:half], None), _all(parts[half:], None))
    else:
        out = parts[0]
    return {(a, b) for a, b in out if (start is None or a == start) and (end is None or b == end)}


def chunks(docs: DataFrame, margin: int, size: int) -> DataFrame:
    """(key, doc_id, body, k, a, b, total, at, held, marked): rows of (key, doc_id, text) in chunks.

    `body` is a digest of the text, whose copies share their states; `marked`: the chunk holds the mark of a space itself.
    """
    names = ["key", "doc_id", "body", "k", "a", "b", "total", "at", "held", "marked"]
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.bool_()]

    def run(batches):
        for batch in sliced(batches):
            out = []
            for key, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = text or ""
                s, body = normal(text), hashlib.blake2b(text.encode(), digest_size=16).digest()
                for k, a in enumerate(range(0, max(1, len(s)), size)):
                    b, at = min(len(s), a + size), max(0, a - margin)
                    out.append((key, doc_id, body, k, a, b, len(s), at, s[at : b + margin], SPACE in text[max(0, a - 1) : max(0, b - 1)]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(types), types)], names=names)

    return per_batch(docs, run, "key long, doc_id long, body binary, k long, a long, b long, total long, at long, held string, marked boolean")


_WORK = ["held", "at", "a", "b", "total"]


def transfers(cut: DataFrame, path: str) -> DataFrame:
    """(body, k, total, p, q, r, s): boundary state (p, q) leads to (r, s) through chunk k; once per text."""
    def run(batches):
        m = model(path)
        for batch in sliced(batches):
            out = []
            for row in batch.to_pylist():
                out += [(row["body"], row["k"], row["total"], *x, *y) for x, y in Chunk(m, *(row[c] for c in _WORK)).transfer()]
            columns = list(zip(*out)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64() if k else pa.binary()) for k, c in enumerate(columns)], names=["body", "k", "total", "p", "q", "r", "s"])

    return per_batch(cut, run, "body binary, k long, total long, p long, q long, r long, s long").distinct()


def resolved(found: DataFrame) -> DataFrame:
    """(body, k, p, q, r, s): the one state at both ends of each chunk. A task holds the matrices of one text, a small part of it."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [set(zip(zip(g["p"], g["q"]), zip(g["r"], g["s"]))) for _, g in rows.groupby("k")]
        total = int(rows["total"].iloc[0])
        path = [(0, 0), *boundaries(parts, (0, 0), (total, total)), (total, total)]
        return pd.DataFrame([(rows["body"].iloc[0], k, *path[k], *path[k + 1]) for k in range(len(parts))], columns=["body", "k", "p", "q", "r", "s"])

    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but work: else they end up in one task
    return found.repartition(tasks, "body").groupBy("body").applyInPandas(solve, "body binary, k long, p long, q long, r long, s long")


ENCODED = "key long, doc_id long, k long, ids array<int>, intact boolean"


def encode(docs: DataFrame, path: str, size: int = CHUNK, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema: str = ENCODED) -> DataFrame:
    """(key, doc_id, k, ids, intact): ids of each chunk of each document, in order of k; `intact`: they decode to their text.

    `finish` turns these batches into others, of `schema`, in the task that encodes.

    The ids of a document's chunks, joined, are those of the library over the whole text. A document of
    at most `size` code points is one chunk between two known states. Longer ones are cut anywhere: each
    chunk gives a transfer matrix between the states of its boundaries, the matrices are multiplied, and
    each chunk is encoded on its own between the states found. Chunks are dealt out for their matrices and
    once more to meet their states; texts that are not cut never move, and no text is written to a table.
    Null and empty texts have one chunk without ids. A text that holds the mark of a space itself does not come
    back, so `intact` is false there. Rows that repeat are documents of their own (`key`); other columns are ignored.
    """
    margin = model(path).longest + 1
    long = F.coalesce(F.length("text"), F.lit(0)) >= size  # the leading space is one more
    rows = documents(docs).select((F.monotonically_increasing_id() * 2 + long.cast("int")).alias("key"), "doc_id", "text")
    cut = chunks(rows.where(long), margin, size)
    states = stage(resolved(transfers(cut.repartition("body", "k", "key"), path)))
    found = cut.join(states.hint("merge"), ["body", "k"]).select("key", "doc_id", "k", *_WORK, "p", "q", "r", "s", "marked")

    def run_cut(batches):
        m = model(path)
        for batch in sliced(batches):
            ids, intact = [], []
            for row in batch.to_pylist():
                chunk = Chunk(m, *(row[c] for c in _WORK))
                ids.append(chunk.backtrace((row["p"], row["q"]), (row["r"], row["s"])))
                intact.append(not row["marked"] and m.decode(ids[-1]) == chunk.text(row["q"], row["s"]).replace(SPACE, " "))
            yield _encoded(batch.columns[:3], ids, intact)

    def run_short(batches):
        m = model(path)
        for batch in sliced(batches):
            ids, intact = [], []
            for text in batch.column(2).to_pylist():
                s = normal(text or "")
                ids.append(Chunk(m, s, 0, 0, len(s), len(s)).backtrace((0, 0), (len(s), len(s))))
                intact.append(m.decode(ids[-1]) == (" " + text if text else ""))
            yield _encoded([*batch.columns[:2], pa.array([0] * len(ids), pa.int64())], ids, intact)

    run = lambda encoded: lambda batches: finish(encoded(batches))
    return per_batch(rows.where(~long), run(run_short), schema).union(per_batch(found, run(run_cut), schema))


def _encoded(names: list[pa.Array], ids: list[list[int]], intact: list[bool]) -> pa.RecordBatch:
    return pa.record_batch([*names, pa.array(ids, pa.list_(pa.int32())), pa.array(intact, pa.bool_())], names=["key", "doc_id", "k", "ids", "intact"])


def decode(chunks: DataFrame, path: str) -> DataFrame:
    """(key, doc_id, text) from the rows of `encode`."""
    def run(batches):
        m = model(path)
        for batch in sliced(batches):
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array([m.decode(i) for i in batch.column(3).to_pylist()], pa.string())],
                                  names=["key", "doc_id", "k", "part"])

    parts = per_batch(chunks.select("key", "doc_id", "k", "ids"), run, "key long, doc_id long, k long, part string")
    return parts.groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("all")) \
        .select("key", "doc_id", F.substring(F.array_join(F.transform("all", lambda x: x["part"]), ""), 2, 2**31 - 1).alias("text"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document: chunks, ids, a checksum of the ids with their places, and whether they decode to the text."""
    import public_tokenizers

    found = encode(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), CHUNK, _digests,
                   "key long, doc_id long, k long, n long, s long, t long, intact boolean")
    ahead = F.sum("n").over(Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    found = found.withColumn("before", F.coalesce(ahead, F.lit(0)))
    return found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n_chunks"), F.sum("n").alias("n_ids"),
                                    F.sum(wide("before") * wide("s") + wide("t")).cast("string").alias("ids_sum"), F.min("intact").alias("round_trip")).drop("key")


def _digests(batches):
    """Of each chunk: ids, sum of id + 1, sum of (id + 1) * place."""
    for batch in batches:
        ids = batch.column(3)
        ends = np.cumsum(np.diff(ids.offsets.to_numpy()))
        value = ids.flatten().to_numpy().astype(np.int64) + 1
        n = np.diff(np.concatenate([[0], ends]))
        place = np.arange(len(value)) - np.repeat(ends - n, n) + 1
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (value, value * place)]
        yield pa.record_batch([*(batch.column(k) for k in range(3)), *[pa.array(x, pa.int64()) for x in (n, *sums)], batch.column(4)],
                              names=["key", "doc_id", "k", "n", "s", "t", "intact"])
