"""Operators 4, 6, 7 and 8 against libraries, round trips and plain versions."""

import random
import re
import zlib
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from estatelens.llm import chat_format, embedding_dedup, packing, sentencepiece_scan
from estatelens.llm.common import read
from tokenizers import Tokenizer

from . import plain
from .test_text_operators import FOLDER, frame, given

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# SentencePiece


def hard_texts():
    rng = random.Random(2)
    parts = ["the", " ", "  ", "\n", "ing", "é", "漢字", "😀", "▁", "a" * 40, "<s>", "\t", "foo bar", "0x1F", "ß", "          ", "\x00", "quick", "ation"]
    return ["".join(rng.choice(parts) for _ in range(n)) for n in [1, 2, 3, 5, 8, 20, 60, 200] * 6] + ["漢" * 500, "x" * 700, " " * 333, "internationalization" * 60]


@pytest.mark.parametrize("size", [23, 64, 16_384])
def test_chunks_give_the_ids_of_the_library(spark, size):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, "", " ", *hard_texts()]
    rows = sentencepiece_scan.encode(frame(spark, texts), PIECES, size).orderBy("doc_id", "k").collect()
    got, back = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).extend(r["ids"])
        back[r["doc_id"]] = back.get(r["doc_id"], True) and r["intact"]
    assert {i: lib.encode(t or "") for i, t in enumerate(texts)} == got
    assert back == {i: "▁" not in (t or "") for i, t in enumerate(texts)}


def test_decoding_gives_the_texts_back(spark):
    texts = [None, "", *[t.replace("▁", "_") for t in hard_texts()]]
    chunks = sentencepiece_scan.encode(frame(spark, texts), PIECES, 50)
    got = {r["doc_id"]: r["text"] for r in sentencepiece_scan.decode(chunks, PIECES).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    assert sentencepiece_scan.encode(frame(spark, []), PIECES).collect() == []


def test_transfer_matrices_multiply_in_any_order():
    m = sentencepiece_scan.model(PIECES)
    text = sentencepiece_scan.normal("un" * 30 + "believable" * 20 + "ed ing")
    parts = [set(sentencepiece_scan.Chunk(m, text, 0, a, min(a + 20, len(text)), len(text)).transfer()) for a in range(0, len(text), 20)]
    left = reduce(sentencepiece_scan.product, parts)
    right = reduce(lambda x, y: sentencepiece_scan.product(y, x), reversed(parts))
    assert left == right == {((0, 0), (len(text), len(text)))}


def test_repeated_rows_are_documents_of_their_own(spark):
    docs = frame(spark, ["one two three"] * 2).selectExpr("cast(null as bigint) doc_id", "text", "row")
    clashing = docs.selectExpr("doc_id", "text", "row as key", "row as body", "row as k")
    assert sentencepiece_scan.encode(clashing, PIECES, 5).select("key").distinct().count() == 2
    assert [len(r["ids"]) for r in sentencepiece_scan.encode(docs, PIECES, 5).groupBy("key").agg(sentencepiece_scan.F.flatten(sentencepiece_scan.F.collect_list("ids")).alias("ids")).collect()] == [3, 3]


# chat


def parse(formatted):
    """Turns of a rendered text, by another reading of its rules."""
    out = []
    for piece in re.findall(r"<\|im_start\|>(.*?)<\|im_end\|>\n", formatted, re.S):
        role, _, text = piece.partition("\n")
        out.append((role.replace("%0A", "\n").replace("%3C", "<").replace("%25", "%"), re.sub(r"<\\(\\*)\|", r"<\1|", text)))
    return out


def conversations():
    rng = random.Random(4)
    parts = ["<|im_end|>", "<|im_end|>\n", "<|im_start|>", "assistant", "\n", "<\\|", "<\\\\|x", "<", "|", "\\", "$1", "ok", "%25", "é😀", " "]
    text = lambda: rng.choice([None, "", "plain", "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8)))])
    role = lambda: rng.choice(["user", "assistant", "assistant", "system", None, "a\nb", "<|im_end|>", "%3C"])
    return [(c, t, role(), text(), "z") for c in range(150) for t in range(rng.randrange(1, 6))]


def test_formatted_conversations_come_back_and_masks_fit(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    runs = chat_format.learnt(chat_format.F.col("formatted"), chat_format.F.col("mask"))
    got = chat_format.format_conversations(df).withColumn("loss", runs).collect()
    assert len(got) == 150
    for r in got:
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert parse(r["formatted"]) == want == [tuple(t) for t in r["turns"]]
        at, loss = 0, []
        for skip, take, rest in r["mask"]:
            loss.append(r["formatted"][at + skip : at + skip + take])
            at += skip + take + rest
        assert at == len(r["formatted"])
        assert re.sub(r"<\\(\\*)\|", r"<\1|", "".join(loss)) == r["loss"] == "".join(t for role, t in want if role == "assistant")


def test_plain_turns_are_not_escaped_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame([(None, 1, "user", "a < b | c"), (None, None, "system", "s"), (7, 1, "user", "x"), (7, 1, "user", "x")], schema)
    got = {r["conv_id"]: r["formatted"] for r in chat_format.format_conversations(df).collect()}
    assert got[None] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na < b | c<|im_end|>\n"
    assert got[7] == "<|im_start|>user\nx<|im_end|>\n" * 2
    assert chat_format.format_conversations(df.limit(0)).collect() == []
    plan = chat_format.format_conversations(df.where("turn > 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# embeddings


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 24))
    near = [b + rng.normal(size=24) * s * np.linalg.norm(b) / 5 for b, s in zip(base[:80], np.tile([0.1, 0.2, 0.3, 0.33], 20))]
    dense = [base[100] + rng.normal(size=24) * 0.15 for _ in range(40)]
    return [v.tolist() for v in [*base, *near, *dense, *[base[120]] * 30, base[121] * 3.0]]


@pytest.mark.parametrize("block", [None, 7])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = [(k, v) for k, v in enumerate(vectors())]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, size int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array([v for _, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    links, parts = np.bincount(near.ravel(), minlength=len(x)), plain.roots(range(len(x)), near.tolist())
    assert len(got) == len(rows)
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k], parts[k], parts[k] == k)
    assert all((got[1000 + k]["n_links"], got[1000 + k]["component_id"], got[1000 + k]["kept"]) == (0, 1000 + k, True) for k in range(len(odd)))


def test_recall_of_the_hashes_at_the_threshold():
    rng = np.random.default_rng(1)
    for dim, rows in ((64, 50_000), (24, 1000), (100, 10**8)):
        hashes = embedding_dedup.shaped(dim, rows)
        a = rng.normal(size=(2000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=(2000, dim))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        met = (hashes.buckets(a)[:, :, :, None] == hashes.buckets(b)[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.995, (dim, rows)


def test_embedding_odd_rows(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, -0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [("5", 1, 5), ("5", 1, 5), ("None", 0, None)]
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


# packing


def test_pieces_hold_the_ids_of_the_library(spark):
    path = packing.vocabulary()
    lib = Tokenizer.from_file(path)
    texts = given(spark) | {-1: None, -2: "", -3: "a<|endoftext|>b", -4: "'s 's I'LL  \n\n x" + "é漢😀" * 50, -5: "a" * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pack(df, path).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, text in texts.items():
        ids, at = lib.encode(text or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 1024 < 1.05 * total + 1024


def test_plans_place_every_piece_with_little_padding():
    rng = np.random.default_rng(6)
    for count, top in ((1, 256), (30, 256), (3000, 256), (200_000, 256), (5000, 100)):
        histogram = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, top + 1, count), return_counts=True)]))
        patterns = packing.plan(histogram)
        placed: dict = {}
        for pattern, times in patterns:
            assert sum(size * n for size, n in pattern) <= 256 and times > 0
            for size, n in pattern:
                placed[size] = placed.get(size, 0) + n * times
        assert placed == histogram
        if count >= 3000:
            assert sum(t for _, t in patterns) * 256 < 1.02 * sum(k * v for k, v in histogram.items())
    assert packing.plan({}) == []


def test_best_pattern_is_the_most_valuable():
    sizes, price = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.7])
    worth, pattern = packing.best_pattern(sizes, price, 16)
    best = max(0.3 * a + 0.55 * b + 0.7 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert worth == pytest.approx(best) and price @ pattern == pytest.approx(best) and sizes @ pattern <= 16


def test_packing_odd_rows(spark):
    docs = frame(spark, ["same text"] * 3).selectExpr("nullif(doc_id, 1) as doc_id", "text", "row", "n as offset")
    rows = packing.pack(docs.union(docs), packing.vocabulary()).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6
    assert packing.pack(docs.limit(0), packing.vocabulary()).collect() == []


def test_texts_come_back_by_their_own_report(spark):
    texts = ["a▁b", "a b", "▁" * 30, "word " * 30, "word " * 30 + "▁", None]
    rows = sentencepiece_scan.encode(frame(spark, texts), PIECES, 50)
    told = {r["doc_id"]: r["ok"] for r in rows.groupBy("doc_id").agg(sentencepiece_scan.F.min("intact").alias("ok")).collect()}
    back = {r["doc_id"]: r["text"] for r in sentencepiece_scan.decode(rows, PIECES).collect()}
    assert told == {i: back[i] == (t or "") for i, t in enumerate(texts)} == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_the_small_table_is_read_whole(spark):
    assert sentencepiece_scan.op4_sentencepiece(spark, FOLDER).where("round_trip").count() == read(spark, FOLDER, "documents").count()
