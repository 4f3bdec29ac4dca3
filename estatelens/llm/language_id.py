"""Operator 5: language by compression with a dictionary of each language."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.llm.common import per_batch, read

SAMPLE_DOCS = 200  # documents of a language that its dictionary is made from, by hash of the doc_id
SAMPLE_CHARS = 4000  # characters of each of them, in pieces spread over the whole text
PIECES = 8
LANGUAGES = 128  # languages that have a dictionary, those with most documents first
DICTIONARY = 256_000  # bytes of a dictionary
BLOCK = 4096  # bytes of text compressed at a time, so that the dictionary counts throughout a long text
LEVEL = 5
MARGIN = 0.01  # a smaller lead of the best language is marked as rejected
NONE = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learnt from; a row without doc_id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pieces(text: Column) -> Column:
    """The text, or PIECES pieces of a longer one: SAMPLE_CHARS code points from places spread evenly from its start to its end."""
    size = SAMPLE_CHARS // PIECES
    last = F.length(text) - size
    cut = F.concat(*[F.substring(text, F.floor(last * k / (PIECES - 1)).cast("int") + 1, F.lit(size)) for k in range(PIECES)])
    return F.when(last > SAMPLE_CHARS - size, cut).otherwise(text)


def shared_room(sizes: list[int], room: int) -> int:
    """The largest share such that texts cut to it fit together: short ones leave their room to the others."""
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > room:
            return room // (len(sizes) - k)
        room -= size
    return max(sizes, default=0)


def dictionary(texts: list[str]) -> bytes:
    """At most DICTIONARY bytes, of which each text has an equal share of whole code points, or all it has."""
    data = [t.encode() for t in texts if t]
    share = shared_room([len(d) + 1 for d in data], DICTIONARY) - 1
    return b"\n".join(d[:share].decode(errors="ignore").encode() for d in data)


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of labelled documents that are not held out.

    The bounds: the LANGUAGES languages with most such documents (ties by name), SAMPLE_DOCS documents of
    each, SAMPLE_CHARS code points spread over each document, DICTIONARY bytes a language, to which all its
    sampled documents add equal shares. Sizes with unequal dictionaries are compared as they are; the README
    has the figures for scarce languages.

    Each task keeps SAMPLE_DOCS rows of a language before rows move, so a language with most of the
    rows costs no more than another. The driver gets SAMPLE_DOCS * SAMPLE_CHARS characters a language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = known.where(F.col("lang").isin([r["lang"] for r in most.collect()])).withColumn("at", F.row_number().over(first)) \
        .where(F.col("at") <= SAMPLE_DOCS).select("lang", "at", pieces(F.col("text")).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows):
        texts.setdefault(row["lang"], []).append(row["text"])
    # a scarce language has a smaller dictionary, and leaves the others theirs
    whole = {lang: dictionary(t) for lang, t in sorted(texts.items())}
    return {lang: content for lang, content in whole.items() if content}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.each = []
        for lang, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.each.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, lead of the smallest size over the next (0 to 1), and whether that is too narrow."""
        if not text or not self.each or not any(map(str.isalpha, text)):
            return NONE, 0.0, True
        data = text.encode()
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.each)
        lead = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], lead, lead < MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, from its text alone.

    The whole text is compressed with each dictionary and the language of the smallest size wins, ties
    by name; `rejected` marks a lead below MARGIN. A null text, one without a letter, or nothing to
    learn from gives `und`, score 0, rejected. Rows that repeat get equal results.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        choose = Compressors(dictionaries)
        for batch in batches:
            found = list(zip(*map(choose, batch.column(2).to_pylist()))) or [(), (), ()]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_()))]],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return per_batch(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = read(spark, folder, "documents")
    return classify(docs, learn(docs))
