"""Matching of processes, components and names across systems."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage, dealt, maybe_broadcast, number_rows, spread_pairs, substrings
from estatelens.functions.sets import (
    at_least, count_map_similarity, keyword_similarity, name_similarity, set_key,
)
from estatelens.functions.text import as_col, clean_table, contained_words, normal_name
from estatelens.operators.grids import BLOCK, grid, jaccards, lists, part, shared, shared_codes


OWN_TABLES = ("tables_involved", "input_sources", "output_targets")


def process_profiles(processes: DataFrame, components: DataFrame) -> DataFrame:
    """Per process: clean table set, domain keywords and counts per component type.

    Tables are those that the process lists itself (columns of OWN_TABLES, arrays); where it has no
    such column, the datasets of its components. The text for keywords is business_function, or without
    one description. Tables are made distinct per process with partial aggregation, so a hot
    process only ever ships its distinct tables and one count per type.
    """
    own = [c for c in OWN_TABLES if c in processes.columns]
    named = processes.select("process_id", F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in own])).alias("t")) if own \
        else components.select("process_id", F.explode(F.array("input_dataset", "output_dataset")).alias("t"))
    tables = (named.select("process_id", clean_table("t").alias("t")).where("t is not null").distinct()
              .groupBy("process_id").agg(F.array_sort(F.collect_list("t")).alias("tables")))
    types = (components.groupBy("process_id", "component_type").agg(F.count("*").alias("n"))
             .groupBy("process_id")
             .agg(F.array_sort(F.collect_list(F.struct("component_type", "n"))).alias("type_counts")))
    texts = [F.when(F.col(c) != "", F.col(c)) for c in ("business_function", "description") if c in processes.columns]
    text = F.coalesce(*texts, F.lit(""))
    profile = (processes
               .select("process_id", "system", "name", contained_words(text, vocab.FUNCTION_KEYWORDS).alias("domains"), (text != "").alias("described"))
               .join(tables, "process_id", "left").join(types, "process_id", "left"))
    return profile.withColumn("tables", F.coalesce("tables", F.array().cast("array<string>"))) \
        .withColumn("type_counts", F.coalesce("type_counts", F.array().cast("array<struct<component_type:string,n:bigint>>")))


def _classes(profiles: DataFrame) -> DataFrame:
    """Profiles with the key of their class: same tables, domains and type counts."""
    return profiles.withColumn(
        "class_key", set_key("tables", "domains", F.transform(
            "type_counts", lambda s: F.concat_ws("=", s["component_type"], s["n"].cast("string"))),
            F.array(F.col("described").cast("string"))))


PAYS = 8  # a join on rare members has to meet so many times fewer pairs than there are


class SetJoin:
    """Two tables of sets (key, tables), numbered rarest first.

    A pair at or above a Jaccard value shares a number within each side's first ones (as many as the value
    leaves room for). How often such numbers meet is counted before anything is joined: where sets are made
    of common tables the join would meet pairs again and again, and a grid of blocks is the cheaper way.
    """

    def __init__(self, left: DataFrame, right: DataFrame, min_jaccard: float):
        both = left.select("tables").unionByName(right.select("tables"))
        freq = both.select(F.explode("tables").alias("t")).groupBy("t").agg(F.count("*").alias("freq"))
        numbers = cut_lineage(number_rows(freq, ["freq", "t"], name="no").select("t", "no"))

        def numbered(df):
            rows = df.select("key", F.explode("tables").alias("t")).join(numbers, "t")
            sets = rows.groupBy("key").agg(F.array_sort(F.collect_list("no")).alias("nos"))
            return cut_lineage(sets.withColumn("id", F.monotonically_increasing_id()))

        self.min_jaccard = min_jaccard
        self.left, self.right = numbered(left), numbered(right)

    def firsts(self, side: str) -> DataFrame:
        n = F.size("nos")
        length = n - F.ceil(n * F.lit(self.min_jaccard)) + 1 if self.min_jaccard > 0 else n
        return getattr(self, side).select(F.col("id").alias(f"{side}_id"), F.explode(F.slice("nos", F.lit(1), F.least(length, n).cast("int"))).alias("no"))

    def join_pays(self) -> bool:
        """Whether the join meets far fewer pairs than a grid looks at."""
        times = [self.firsts(s).groupBy("no").agg(F.count("*").cast("decimal(18,0)").alias(s)) for s in ("left", "right")]
        met = times[0].join(times[1], "no").agg(F.sum(F.col("left") * F.col("right"))).first()[0] or 0
        return met * PAYS <= self.left.count() * self.right.count()

    def joined(self) -> DataFrame:
        """(left_key, right_key, shared, table_score) through shared rare numbers; the sets join in once per pair."""
        candidates = spread_pairs(self.firsts("left").join(self.firsts("right"), "no").select("left_id", "right_id").distinct())
        side = lambda sets, p: sets.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "key", "nos")])
        pairs = candidates.join(side(self.left, "left"), "left_id").join(side(self.right, "right"), "right_id").select(
            "left_key", "right_key", F.size(F.array_intersect("left_nos", "right_nos")).alias("shared"),
            (F.size("left_nos") + F.size("right_nos")).alias("total"))
        pairs = pairs.select("left_key", "right_key", "shared", (F.col("shared") / (F.col("total") - F.col("shared"))).alias("table_score"))
        return pairs.filter(F.round("table_score", 9) >= self.min_jaccard) if self.min_jaccard > 0 else pairs

    def in_blocks(self, function, schema: str) -> DataFrame:
        """`function` of (left keys, right keys, shared members, Jaccard values) of each pair of blocks."""
        def sized(t):
            sets = lists(t.column("nos"))
            return t, sets, np.bincount(sets[1], minlength=t.num_rows)

        def meet(chunk):
            tiles = [sized(part(chunk, at, BLOCK)) for at in range(0, chunk.num_rows, BLOCK)]

            def run(rows):
                a, left, left_size = sized(rows)
                for b, right, right_size in tiles:
                    common = shared(left, right, a.num_rows, b.num_rows)
                    yield function(a.column("key"), b.column("key"), common, jaccards(common, left_size, right_size))

            return run

        return grid(self.left.select("key", "nos"), self.right.select("key", "nos"), meet, schema)


def table_overlaps(left: DataFrame, right: DataFrame, min_jaccard: float = 0.0) -> DataFrame:
    """Pairs (left_key, right_key) of distinct table sets (key, tables) that share a table, with their Jaccard value.

    All pairs at or above `min_jaccard` are listed: ask `best_overlaps` for one per left key.
    """
    sets = SetJoin(left, right, min_jaccard)
    if sets.join_pays():
        return sets.joined()

    def listed(a, b, common, score):
        i, j = np.nonzero((common > 0) & (np.round(score, 9) >= min_jaccard))
        return pa.table({"left_key": a.take(pa.array(i)), "right_key": b.take(pa.array(j)),
                         "shared": pa.array(common[i, j].astype(np.int32)), "table_score": pa.array(score[i, j])})

    return sets.in_blocks(listed, "left_key string, right_key string, shared int, table_score double")


def best_overlaps(left: DataFrame, right: DataFrame, min_jaccard: float) -> DataFrame:
    """(left_key, right_key, table_score, matches): the best right set per left key, the largest key on ties, and how many reach `min_jaccard`.

    Keys of the right side compare by length, then text, so numbered keys compare by number. No pair becomes a row
    unless the join on rare tables pays.
    """
    sets = SetJoin(left, right, min_jaccard)

    def best(a, b, common, score):
        score = np.where((common > 0) & (np.round(score, 9) >= min_jaccard), np.round(score, 9), -1.0)
        matches = (score >= 0).sum(axis=1)
        keys = np.array(b.to_pylist(), object)
        by_key = np.array(sorted(range(len(keys)), key=lambda k: (len(keys[k]), keys[k]), reverse=True), int)
        top = by_key[score[:, by_key].argmax(axis=1)] if len(keys) else np.zeros(len(a), int)
        rows = np.flatnonzero(matches)
        return pa.table({"left_key": a.take(pa.array(rows)), "right_key": pa.array(keys[top[rows]], pa.string()),
                         "table_score": pa.array(score[rows, top[rows]]), "matches": pa.array(matches[rows].astype(np.int64))})

    pairs = sets.joined().select("left_key", "right_key", F.round("table_score", 9).alias("table_score"), F.lit(1).cast("bigint").alias("matches")) if sets.join_pays() \
        else sets.in_blocks(best, "left_key string, right_key string, table_score double, matches long")
    top = F.max_by(F.struct("right_key", "table_score"), F.struct("table_score", F.length("right_key"), "right_key")).alias("top")
    return pairs.groupBy("left_key").agg(top, F.sum("matches").alias("matches")).select("left_key", "top.right_key", "top.table_score", "matches")


def needed_overlap(threshold: float) -> float:
    """The least Jaccard value of tables with which a pair can reach the threshold."""
    w = vocab.PROCESS_WEIGHTS
    return max(0.0, math.floor((threshold - w["name"] - w["domain"] - w["components"]) / w["tables"] * 1e9) / 1e9)


def score_process_pairs(profiles: DataFrame, source: str, target: str, threshold: float) -> DataFrame:
    """Pairs of processes at or above a threshold that needs a shared table, through their rare tables."""
    w = vocab.PROCESS_WEIGHTS
    min_jaccard = needed_overlap(threshold)
    if min_jaccard <= 0:
        raise ValueError("pairs without a shared table can reach this threshold: see best_processes")
    classes = cut_lineage(_classes(profiles))
    side = lambda system: classes.filter(F.col("system") == system)
    distinct = lambda system: side(system).groupBy(F.col("class_key").alias("key")).agg(
        F.first("tables").alias("tables"), F.first("domains").alias("domains"),
        F.first("type_counts").alias("type_counts"), F.first("described").alias("described"))
    src, tgt = distinct(source), distinct(target)
    pairs = table_overlaps(src.select("key", "tables"), tgt.select("key", "tables"), min_jaccard)
    info = lambda df, p: df.select(F.col("key").alias(f"{p}_key"), F.col("domains").alias(f"{p}_domains"),
                                   F.map_from_entries("type_counts").alias(f"{p}_types"),
                                   F.col("described").alias(f"{p}_described"))
    pairs = pairs.join(info(src, "left"), "left_key").join(info(tgt, "right"), "right_key")
    domain = F.when(F.col("left_described") & F.col("right_described"),
                    keyword_similarity("left_domains", "right_domains")).otherwise(0.0)
    pairs = pairs.withColumn("domain_score", domain) \
                 .withColumn("component_score", count_map_similarity("left_types", "right_types"))
    base = (w["tables"] * F.col("table_score") + w["domain"] * F.col("domain_score")
            + w["components"] * F.col("component_score"))
    pairs = pairs.withColumn("base", base).filter(at_least(F.col("base") + w["name"], threshold)) \
                 .select("left_key", "right_key", "table_score", "domain_score", "component_score", "base")
    members = lambda system, p: side(system).select(
        F.col("class_key").alias(f"{p}_key"), F.col("process_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    out = pairs.join(members(source, "left"), "left_key").join(members(target, "right"), "right_key")
    out = out.withColumn("name_score", name_similarity("left_name", "right_name"))
    out = out.withColumn("score", F.round(F.col("base") + w["name"] * F.col("name_score"), 9))
    return out.filter(F.col("score") >= threshold).select(
        F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"),
        "name_score", "table_score", "domain_score", "component_score", "score")


def _name_score(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.8
    a, b = set(x.split("_")), set(y.split("_"))
    return len(a & b) / len(a | b)


_BEST = "source_id string, target_id string, name_score double, table_score double, domain_score double, component_score double, score double"
TILE = 2048  # targets scored at once
SLACK = 2e-9  # scores are rounded to nine digits, bounds are not


class _Side:
    """Columns of some processes as arrays; sets of words and kinds of components as numbers of their classes or rows of counts."""

    def __init__(self, t: pa.Table):
        self.rows = t.num_rows
        self.ids = t.column("process_id").to_pylist()
        self.low = [(x or "").lower() for x in t.column("name").to_pylist()]
        self.masks = np.array([_bigrams(x) for x in self.low], np.uint64)
        tokens = [sorted(set(x.split("_"))) for x in self.low]
        self.token_size = np.array([len(x) for x in tokens], np.int64)
        self.tokens = np.array([w for x in tokens for w in x], object), np.repeat(np.arange(self.rows), self.token_size)
        tables = t.column("tables").combine_chunks()
        tables = tables.combine_chunks() if isinstance(tables, pa.ChunkedArray) else tables
        self.tables, self.table_size = tables.flatten(), np.diff(tables.offsets.to_numpy())
        self.table_row = np.repeat(np.arange(self.rows), self.table_size)
        known: dict[tuple, int] = {}
        words = [(bool(d), frozenset(w)) for d, w in zip(t.column("described").to_pylist(), t.column("domains").to_pylist())]
        self.word_class = np.array([known.setdefault(x, len(known)) for x in words], np.int64)
        self.word_sets = list(known)
        kinds, row = lists(t.column("types"))
        counts = lists(t.column("counts"))[0].astype(float)
        self.typed = np.bincount(row, minlength=self.rows) > 0
        self.counts = {kind: np.bincount(row[kinds == kind], counts[kinds == kind], self.rows) for kind in set(kinds)}


def _null_first(text: str | None) -> tuple[bool, str]:
    return text is not None, text or ""


def _bigrams(name: str) -> int:
    """64 bits of the neighbouring letters: those of a text hold those of each part of it."""
    bits = 0
    for x, y in zip(name, name[1:]):
        bits |= 1 << ((ord(x) * 31 + ord(y)) & 63)
    return bits


def _word_score(x: tuple, y: tuple) -> float:
    if not x[0] or not y[0]:
        return 0.0
    if not x[1] and not y[1]:
        return 0.5
    return len(x[1] & y[1]) / len(x[1] | y[1])


def best_processes(profiles: DataFrame, source: str, target: str, threshold: float) -> DataFrame:
    """Best target per source process at any threshold, by comparing all of both sides (`grid`).

    Table sets and words are compared first; with full marks for the rest they bound the score. Component counts are compared
    for pairs that can still reach the best target found so far, names for those that can with their counts. A source
    gets one row per chunk of the targets at most.
    """
    w = vocab.PROCESS_WEIGHTS
    keep = ["process_id", "name", "domains", "described", "tables", "type_counts"]
    side = lambda system: profiles.filter(F.col("system") == system).select(
        *keep[:-1], F.col("type_counts.component_type").alias("types"), F.transform("type_counts", lambda x: x["n"]).alias("counts"))
    columns = [x.split()[0] for x in _BEST.split(", ")]

    def meet(chunk: pa.Table):
        if not chunk.num_rows:
            return lambda rows: ()
        b = _Side(chunk)
        every = b.tables.dictionary_encode()
        held = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(b.table_size)])
        words, word_code = np.unique(b.tokens[0], return_inverse=True)
        word_no = {x: k for k, x in enumerate(words)}
        word_ends = np.concatenate([[0], np.cumsum(b.token_size)])
        rank = np.empty(b.rows, np.int64)
        rank[sorted(range(b.rows), key=lambda k: _null_first(b.ids[k]))] = np.arange(b.rows)

        def best(rows: pa.Table):
            a = _Side(rows)
            code = pc.index_in(a.tables, value_set=every.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            used, own = np.unique(code[code >= 0], return_inverse=True)
            number = np.full(len(every.dictionary), -1)
            number[used] = np.arange(len(used))
            own = own, a.table_row[code >= 0]
            token = np.array([word_no.get(x, -1) for x in a.tokens[0]], np.int64)
            spoken, said = np.unique(token[token >= 0], return_inverse=True)
            word_number = np.full(len(words), -1)
            word_number[spoken] = np.arange(len(spoken))
            said = said, a.tokens[1][token >= 0]
            by_words = np.array([[_word_score(x, y) for y in b.word_sets] for x in a.word_sets])[a.word_class]
            kinds = sorted({*a.counts, *b.counts}, key=_null_first)
            top, at = np.full(a.rows, float(threshold)), np.full(a.rows, -1)
            parts = np.zeros((a.rows, 4))

            for first in range(0, b.rows, TILE):
                last = min(first + TILE, b.rows)
                shape = a.rows, last - first

                def met(codes, own, number, ends):
                    c = number[codes[ends[first] : ends[last]]]
                    row = np.repeat(np.arange(shape[1]), np.diff(ends[first : last + 1]))
                    return shared_codes(own, (c[c >= 0], row[c >= 0]), len(own[0]) and int(own[0].max()) + 1, *shape)

                table = jaccards(met(held, own, number, ends), a.table_size, b.table_size[first:last])
                domain = by_words[:, b.word_class[first:last]]
                i, j = np.nonzero(w["tables"] * table + w["domain"] * domain + (w["components"] + w["name"] + SLACK) >= top[:, None])
                if not len(i):
                    continue
                table, domain, j = table[i, j], domain[i, j], j + first

                component, n = np.zeros(len(i)), np.zeros(len(i))
                nothing = np.zeros(max(a.rows, b.rows))
                for kind in kinds:
                    x, y = a.counts.get(kind, nothing)[i], b.counts.get(kind, nothing)[j]
                    most = np.maximum(x, y)
                    component += np.where(most > 0, 1 - np.abs(x - y) / np.maximum(most, 1.0), 0.0)
                    n += most > 0
                component = np.where(a.typed[i] & b.typed[j], np.divide(component, n, out=np.zeros(len(i)), where=n > 0), 0.0)
                base = w["tables"] * table + (w["domain"] * domain + w["components"] * component)
                able = np.flatnonzero(base + (w["name"] + SLACK) >= top[i])
                if not len(able):
                    continue
                i, j, table, domain, component, base = (x[able] for x in (i, j, table, domain, component, base))

                common = met(word_code, said, word_number, word_ends)[i, j - first].astype(float)
                name = common / (a.token_size[i] + b.token_size[j] - common)
                x, y = a.masks[i], b.masks[j]
                inside = ((x & ~y) == 0) | ((y & ~x) == 0)  # one name may hold the other, or be the same
                score = np.where(inside, -1.0, np.round(base + w["name"] * name, 9))
                least = top.copy()
                np.maximum.at(least, i, score)
                for k in np.flatnonzero(inside & (base + w["name"] * np.maximum(name, 0.8) + SLACK >= least[i])):
                    name[k] = _name_score(a.low[i[k]], b.low[j[k]])
                    score[k] = np.round(base[k] + w["name"] * name[k], 9)
                np.maximum.at(least, i, score)

                hit = np.flatnonzero((score >= threshold) & (score >= least[i]))
                hit = hit[np.lexsort((rank[j[hit]], i[hit]))]
                for k in hit[np.concatenate([[True], i[hit][1:] != i[hit][:-1]])] if len(hit) else ():
                    s = i[k]
                    if at[s] < 0 or score[k] > top[s] or rank[j[k]] < rank[at[s]]:
                        top[s], at[s], parts[s] = score[k], j[k], (name[k], table[k], domain[k], component[k])

            s = np.flatnonzero(at >= 0)
            yield pa.table([pa.array([a.ids[k] for k in s], pa.string()), pa.array([b.ids[at[k]] for k in s], pa.string()),
                            *[pa.array(parts[s, c]) for c in range(4)], pa.array(top[s])], names=columns)

        return best

    return grid(side(source), side(target), meet, _BEST, 512)


def match_processes(processes: DataFrame, components: DataFrame, source: str, target: str,
                    threshold: float = vocab.PROCESS_THRESHOLD) -> DataFrame:
    """Best target per source process at any threshold; ties go to the lowest target id.

    Where the threshold needs a shared table and rare tables tell processes apart, pairs are met through
    them; else blocks are compared. Either way the best pick is an aggregate with partial results.
    """
    profiles = cut_lineage(process_profiles(processes, components))
    side = lambda system: _classes(profiles).filter(F.col("system") == system).groupBy(F.col("class_key").alias("key")).agg(F.first("tables").alias("tables"))
    needed = needed_overlap(threshold)
    by_join = needed > 0 and SetJoin(side(source), side(target), needed).join_pays()
    pairs = (score_process_pairs if by_join else best_processes)(profiles, source, target, threshold)
    best = pairs.groupBy("source_id").agg(F.min_by(
        F.struct("target_id", "score"), F.struct(-F.col("score"), F.col("target_id"))).alias("best"))
    return best.select("source_id", "best.*")


def name_pairs(names: DataFrame, left: str, right: str, left_tokens: str | None = None, right_tokens: str | None = None) -> DataFrame:
    """Adds the name similarity of two columns; columns of tokens spare the split of names per pair."""
    return names.withColumn("name_score", name_similarity(left, right, left_tokens, right_tokens))


def domain_pairs(pairs: DataFrame, left: str, right: str, vocabulary=None) -> DataFrame:
    """Adds the similarity of the domain words in two columns: texts, or arrays of the words found in them before they were paired."""
    words_ = vocabulary or vocab.FUNCTION_KEYWORDS
    found = lambda c: F.col(c) if isinstance(pairs.schema[c].dataType, T.ArrayType) else contained_words(c, words_)
    return pairs.withColumn("domain_score", keyword_similarity(found(left), found(right)))


def count_similarity(counts: DataFrame, left: str, right: str) -> DataFrame:
    """Similarity of two maps of counts per component type."""
    return counts.withColumn("component_score", count_map_similarity(left, right))


ROWS_PER_TASK, NAMES_PER_TASK = 1_000_000, 100_000  # a name is met in many substrings
PAIRS_AT_ONCE = 1_000_000  # pairs of processes that a task may hold


def equivalent_component(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """First target component per source component of matched processes.

    Rule order: equal name, one name inside the other, shared dataset; lowest id wins.
    `pairs` has (source_process, target_process); components have (component_id, process_id,
    name, datasets) and should be cheap to read several times, as they are not kept. Both sides are reduced to one row
    per join key before joining, so no step emits all pairs of a process or a dataset; components move once, by name,
    and by dataset only those that no name gave a target.
    """
    columns = ["component_id", F.col("target_process").alias("pid"), F.lower("name").alias("nm"), "datasets"]
    pairs = cut_lineage(pairs.select("source_process", "target_process"))
    src = source.join(maybe_broadcast(pairs, PAIRS_AT_ONCE), F.col("process_id") == F.col("source_process")).select(*columns)
    targets = cut_lineage(pairs.select("target_process").distinct())
    tgt = target.join(maybe_broadcast(targets, PAIRS_AT_ONCE), F.col("process_id") == F.col("target_process")).select(*columns)
    # the least of texts is found by sorting a task's rows, so a task gets a bounded number of them
    few = dealt(tgt.select("component_id", "pid", "nm"), ROWS_PER_TASK, "component_id")
    names = cut_lineage(few.groupBy("pid", "nm").agg(F.min("component_id").alias("hit")))
    src_names = cut_lineage(src.select("pid", "nm").distinct())
    # names are few compared with components; both directions of containment are equality joins
    lengths = lambda df: df.groupBy("pid").agg(F.collect_set(F.length("nm")).alias("lens"))
    parts = lambda df: dealt(cut_lineage(df), NAMES_PER_TASK, "pid", "nm")
    inside = parts(names.join(lengths(src_names), "pid")).select("pid", "hit", F.explode(substrings("nm", F.col("lens"))).alias("nm")) \
        .groupBy("pid", "nm").agg(F.min("hit").alias("hit"))
    around = parts(src_names.join(lengths(names), "pid")) \
        .select("pid", F.col("nm").alias("full"), F.explode(substrings("nm", F.col("lens"))).alias("nm")) \
        .join(names.hint("merge"), ["pid", "nm"]).groupBy("pid", F.col("full").alias("nm")).agg(F.min("hit").alias("hit"))
    by_name = (names.select("pid", "nm", F.lit(1).alias("rule"), "hit")
               .unionByName(inside.unionByName(around).join(src_names, ["pid", "nm"], "left_semi").select("pid", "nm", F.lit(2).alias("rule"), "hit"))
               .groupBy("pid", "nm").agg(F.min(F.struct("rule", "hit")).alias("name_hit")))
    named = cut_lineage(src.join(by_name.hint("merge"), ["pid", "nm"], "left").select("component_id", "pid", "datasets", "name_hit"))
    row = lambda df, best: df.select(F.col("component_id").alias("source_component"), F.col(f"{best}.hit").alias("target_component"), F.col(f"{best}.rule").alias("rule"))
    found, rest = row(named.filter("name_hit is not null"), "name_hit"), named.filter("name_hit is null")
    if rest.isEmpty():
        return found
    # the least target of a component's datasets counts in all of its rows
    ids = cut_lineage(rest.select("component_id").distinct())
    left = named.join(maybe_broadcast(ids), "component_id", "left_semi") \
        .select("component_id", "pid", F.explode(F.array_distinct("datasets")).alias("ds"))
    io = tgt.select("pid", F.explode("datasets").alias("ds"), "component_id") \
        .groupBy("pid", "ds").agg(F.min("component_id").alias("hit"))
    by_io = dealt(left, ROWS_PER_TASK, "pid", "ds").join(io.hint("merge"), ["pid", "ds"]).groupBy("component_id").agg(F.struct(F.lit(3).alias("rule"), F.min("hit").alias("hit")).alias("io_hit"))
    return found.unionByName(row(rest.join(by_io, "component_id").filter("io_hit.hit is not null"), "io_hit"))


def name_matches(a: DataFrame, b: DataFrame, name="name") -> DataFrame:
    """Workflows with the same name after dropping case, underscore, hyphen and space."""
    left = a.select(F.col(name).alias("source_name"), normal_name(name).alias("k"))
    right = b.select(F.col(name).alias("target_name"), normal_name(name).alias("k"))
    return left.join(right, "k").drop("k")


def name_search(hits: DataFrame, entity="entity", path="path", rank="rank") -> DataFrame:
    """Score of a hit for an entity name: path 0.7, file 0.6, name part 0.5, top five 0.4."""
    e, p = F.lower(as_col(entity)), F.lower(as_col(path))
    f = F.lower(F.element_at(F.split(as_col(path), "/"), -1))
    score = (F.when(p.contains(e), 0.7).when(f.contains(e), 0.6)
             .when(F.exists(F.split(e, "_"), lambda w: f.contains(w)), 0.5)
             .when(as_col(rank) <= 5, 0.4))
    return hits.withColumn("score", score).filter(F.col("score").isNotNull())


def inherit_group(components: DataFrame, groups: DataFrame, key="process_id") -> DataFrame:
    """Components take the group of their process; without a process they drop out."""
    return components.join(groups, key)


def flow_level(matches: DataFrame) -> DataFrame:
    """Best equivalent per (entity, target system) with the number of matches."""
    top = F.max_by(F.struct("target_entity", "score"),
                   F.struct(F.col("score"), F.col("target_order"))).alias("top")
    return (matches.groupBy("entity", "target_system").agg(top, F.count("*").alias("match_count"))
            .select("entity", "target_system", "top.target_entity", "top.score", "match_count",
                    F.lit("equivalent_implementation").alias("relationship_type")))


def containing_names(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(ref, name): first name with ref inside name, name inside ref, or equal to ref's stem.

    Containment becomes equality on substrings; each side is reduced to the lowest name per
    substring first, so the work is linear in the rows times the squared name length.
    """
    refs, names = refs.select("ref").distinct(), names.select("name").distinct()
    lens = lambda df, c: df.agg(F.collect_set(F.length(c)).alias("lens"))  # one short row
    in_ref = refs.join(F.broadcast(lens(names, "name"))) \
        .select("ref", F.explode(substrings("ref", F.col("lens"))).alias("name")).join(names, "name")
    in_name = names.join(F.broadcast(lens(refs, "ref"))) \
        .select("name", F.explode(substrings("name", F.col("lens"))).alias("ref")) \
        .groupBy("ref").agg(F.min("name").alias("name")).join(refs, "ref")
    return in_ref.select("ref", "name").unionByName(in_name.select("ref", "name")) \
        .groupBy("ref").agg(F.min("name").alias("name"))
