"""Operators 11, 12 and 13 against plain versions and libraries, and what they do with odd rows."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm import best_fit, filter_audit, packing, source_divergence

from . import plain
from .test_text_operators import FOLDER, frame, given

# filter interaction audit


def plain_audit(rows, good, toxic):
    """{(part, order, step): counts} of (doc_id, text, lang) rows, by trying each order on each row."""
    least, out, parts = {}, defaultdict(Counter), defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in rows:
        t = text or ""
        w = plain.words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        parts[lang or ""].append((i, {f for f in fails if fails[f]}))
    for part, own in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, fails) for i, fails in left if f in fails]
                left = [(i, fails) for i, fails in left if f not in fails]
                out[part, order, step] = [len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    total = Counter()
    for (part, order, step), x in out.items():
        total[part, order[step - 1]] += x[1]
    return {k: (*x, total[k[0], k[1][k[2] - 1]]) for k, x in out.items()}


def audited(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()) for r in found.collect()}


def audit_rows():
    rng = random.Random(8)
    words = ["one", "two", "Three", "FOUR", "f#ve", "x", "é"] + [f"w{k}" for k in range(150)]
    texts = [None, "", " ", "ALL CAPS", "#", " ".join(words), " ".join(words[7:]), " ".join(words[7:]) + "\n" + "Z" * 90, "same " * 120]
    texts += [" ".join(rng.choices(words, k=rng.choice([3, 99, 100, 160]))) for _ in range(30)]
    rows = [(rng.choice([k, k, k, None, 5]), rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(200)]
    return rows + rows[:20]


def test_audit_equals_trying_every_order(spark):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string")
    marks = [(k, k % 3 if k % 7 else None, k % 2, "r") for k in range(0, 200, 2)] + [(4, 1, 1, "r"), (None, 1, 1, "r")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, good string")
    good, toxic = ({m[0] for m in marks if m[0] is not None and m[at] == 1} for at in (1, 2))
    assert audited(filter_audit.audit(docs, labels)) == plain_audit(rows, good, toxic)
    assert audited(filter_audit.audit(docs.limit(0), labels)) == {}
    assert all(x[4] == x[5] == 0 for x in audited(filter_audit.audit(docs, labels.limit(0))).values())


def test_intervals_hold_each_order_once_per_mask():
    orders = list(permutations(range(5)))
    for mask in range(1, 32):
        step_of = {}
        for m, step, start, stop in filter_audit.intervals():
            for rank in range(start, stop) if m == mask else ():
                assert rank not in step_of
                step_of[rank] = step
        assert step_of == {r: 1 + next(k for k, f in enumerate(o) if mask >> f & 1) for r, o in enumerate(orders)}


def test_orders_come_by_rank(spark):
    got = [r[0] for r in spark.range(120).select(filter_audit.order_of(F.col("id"))).collect()]
    assert sorted(got) == list(map("".join, permutations("ABCDE"))) == [r[0] for r in spark.range(120).coalesce(1).select(filter_audit.order_of(F.col("id"))).collect()]


def test_masks_of_very_long_texts_equal_the_plain_ones():
    text = ("word " * 400_000 + "\n" + " ".join(f"w{k}" for k in range(200_000))).encode()
    assert filter_audit.own_mask(text) == 1 << 1
    assert filter_audit.own_mask(b"x" * 3_000_000) == 1 << 0


# source divergence


def plain_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", Counter(t for t in plain.re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain.lower(text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, groups, every = Counter(), defaultdict(Counter), Counter()
        for own, source, terms in docs:
            if own == lang:
                held.update(terms.keys())
                groups[source].update(terms)
                every.update(terms)
        kept = [t for t in held if held[t] >= least]
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n[u] for u in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(n) for s, n in groups.items()}, share(every)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(x, sum(gap(p[s][t], p[x][t]) for t in kept)) for x in groups if x != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def divergence_rows():
    rng = random.Random(9)
    words = ["the", "The", "ÄÖ", "äö", "漢字", "x-y", "don't", "rare1", "😀", "z"] + [f"t{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice([None, "", "1 2 3", " ".join(rng.choices(words, k=rng.randrange(1, 30)))]), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "s3", "S", "", None])) for _ in range(300)]
    return rows + rows[:30] + [("only here", "fr", "a"), (None, "fr", "b"), ("word " * 12, "xx", "alone")]


def test_divergence_equals_the_plain_version(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n long, term string")
    got = sorted(tuple(r[c] for c in "lang source part item value rank".split()) for r in source_divergence.divergence(docs).collect())
    assert got == plain_divergence(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got
    assert source_divergence.divergence(docs.limit(0)).collect() == []


def test_vectors_are_those_of_count_vectorizer(spark):
    rows = [(t, g, s) for t, g, s in divergence_rows() if (g or "") == "en"]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    vectors = source_divergence.document_vectors(docs)
    kept = {r["term"]: r["lang_n"] for r in source_divergence.vocabulary(source_divergence.group_sums(vectors)).where("head").collect()}
    model = CountVectorizer(inputCol="w", outputCol="v", minDF=10, vocabSize=2**31 - 1).fit(vectors.select(
        F.flatten(F.zip_with("terms", "counts", lambda t, n: F.array_repeat(t, n.cast("int")))).alias("w")))
    again = vectors.select("terms", "counts", F.flatten(F.zip_with("terms", "counts", lambda t, n: F.array_repeat(t, n.cast("int")))).alias("w"))
    assert set(model.vocabulary) == set(kept)
    for r in model.transform(again).collect():
        assert {model.vocabulary[k]: n for k, n in zip(r["v"].indices, r["v"].values)} == {t: n for t, n in zip(r["terms"], r["counts"]) if t in kept}


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, terms = 9 * 10**17, 4 * 10**18, 12345
    got = spark.range(1).select(source_divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_terms_of_long_texts_are_counted_whole():
    assert source_divergence.term_counts(b"Ab cd2ef " * 1000, 7) == Counter({b"ab": 1000, b"cd": 1000, b"ef": 1000})


# best-fit packing


def check_packing(rows, texts):
    """Every id lies in one piece, pieces are cut as told, and sequences have no gap and no overflow."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        assert [r["length"] for r in own[1:]] == [1024] * (len(own) - 1) and sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(sequences)


@pytest.mark.parametrize("node", [100, 100_000])
def test_best_fit_of_all_documents(spark, node):
    texts = given(spark) | {-1: None, -2: "", -3: "word " * 1023, -4: "word " * 1022, -5: "a b" * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = best_fit.pack(docs, packing.vocabulary(), node=node).collect()
    n, total = check_packing(rows, texts), sum(r["length"] for r in rows)
    assert n * 1024 < (1.02 if node > 1000 else 1.06) * total + 1024


def test_best_fit_takes_the_fullest_bin_with_room():
    assert best_fit.best_fit(np.array([6, 7, 3, 4, 2, 8]), 10).tolist() == [2, 1, 1, 2, 0, 0]
    assert best_fit.best_fit(np.array([], int)).tolist() == []
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 30, 60)
        place, room = best_fit.best_fit(sizes, 30), {}
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in room.values() if r >= sizes[i]]
            if place[i] in room:
                assert room[place[i]] == min(fits)
            else:
                assert not fits
                room[place[i]] = 30
            room[place[i]] -= sizes[i]


def test_underfull_bins_are_merged_in_rounds(spark):
    """Halves and slightly shorter ones, dealt to many nodes: what one leaves open another one's rest fills."""
    texts = {k: "word " * (700 if k % 2 else 300) for k in range(400)}
    rows = best_fit.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), packing.vocabulary(), node=50).collect()
    assert check_packing(rows, texts) <= 215


def test_best_fit_odd_rows(spark):
    docs = frame(spark, ["same text", None, ""]).selectExpr("nullif(doc_id, 1) as doc_id", "text", "row", "n as offset", "n as pieces")
    rows = best_fit.pack(docs.union(docs), packing.vocabulary()).collect()
    assert len(rows) == 6 and len({r["sequence_id"] for r in rows}) == 1 and len({r["offset"] for r in rows}) == 6
    assert sorted(r["length"] for r in rows) == [1, 1, 1, 1, 3, 3]
    assert best_fit.pack(docs.limit(0), packing.vocabulary()).collect() == []
    assert best_fit.op13_best_fit(spark, FOLDER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
