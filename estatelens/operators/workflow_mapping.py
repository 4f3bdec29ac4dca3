"""Workflow signatures, pair similarity and N:1 / 1:N / 1:1 mappings between systems.

Scores compare four sets: source tables, target tables, transformation kinds, keywords.
Listing all pairs is quadratic, and most pairs share no table. So pairs are counted in three
layers; each pair of workflows belongs to exactly one of them:

* close pairs share a table that is not hot; signature classes are joined through their tables;
* hot pairs share hot tables only, so their score follows from a coarse class: logic sets plus,
  per side, the hot tables and the set size. Coarse classes are joined through their hot tables;
* all other pairs share no table. Their score follows from their cells, the logic and keyword
  sets: a cell pair counts all its workflow pairs but those of the other two layers.

A pair that shares several tables is met at the first of them only. More shared tables never
lower a score, so a pair in an accepted cell pair or coarse pair is accepted in every layer.
A table is hot when more than `hot_limit` signature classes use it; the limit changes which
layer counts a pair and what that costs, never a result. Sums of scores are exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage, spread_pairs
from estatelens.functions.sets import DIGITS, at_least, jaccard, overlap, set_key
from estatelens.functions.text import contained_words, find_all, normal_transformation

# --- Fixed values: patterns that make a signature ------------------------------
FROM_NAME = r"(?i)\bFROM\s+([a-z_][a-z0-9_]*)"
LOAD_PATH = r"(?i)LOAD\s+'([^']+)'"
STORE_PATH = r"(?i)STORE\s+\w+\s+INTO\s+'([^']+)'"
READ_PATH = r"""(?i)read\.\w+\s*\(\s*["']([^"']+)["']\s*\)"""
WRITE_PATH = r"""(?i)write\.\w+\([^)]*\)\.save\s*\(\s*["']([^"']+)["']\s*\)"""
INSERT_NAME = r"(?i)INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?([a-z_][a-z0-9_]*)"
READ_TABLE = r"""(?i)(?:read\.table|spark\.table)\s*\(\s*["']([^"']+)["']\s*\)"""
SAVE_TABLE = r"""(?i)(?:saveAsTable|insertInto)\s*\(\s*["']([^"']+)["']\s*\)"""

SETS = ["source_tables", "target_tables", "transformation_types", "business_keywords"]
FILES = ["source_files", "target_files"]


def _lower_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.concat(*arrays), lambda x: F.lower(x))))


def _paths(hadoop: Column, databricks: Column, first: str, second: str) -> Column:
    """Set of the paths that a pattern of the system finds, as they are written."""
    found = F.when(hadoop, find_all("content", first)).when(databricks, find_all("content", second)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(found))


def signatures(scripts: DataFrame, files: bool = False) -> DataFrame:
    """Signature per workflow (system, name, path) from script text; last path wins per name.

    `files` adds the sets of paths that are read and written as files, which gives the columns of
    `sources.files.signatures_from_json`, so both kinds go into one table by name.
    """
    up, low = F.upper("content"), F.lower("content")
    hadoop, databricks = F.col("system") == "hadoop", F.col("system") == "databricks"
    none = F.array().cast("array<string>")
    sources = (F.when(hadoop, _lower_set(find_all("content", FROM_NAME)))
               .when(databricks, _lower_set(find_all("content", READ_TABLE), find_all("content", FROM_NAME)))
               .otherwise(none))
    targets = (F.when(hadoop, _lower_set(find_all("content", INSERT_NAME)))
               .when(databricks, _lower_set(find_all("content", SAVE_TABLE))).otherwise(none))
    flag = lambda h, d, kind: F.when((hadoop & h) | (databricks & d), kind)
    kinds = F.array_compact(F.array(
        flag(up.contains("FILTER"), low.contains(".filter(") | low.contains(".where("), "filter"),
        flag(up.contains("GROUP"), low.contains(".groupby("), "group_by"),
        flag(up.contains("JOIN"), low.contains(".join("), "join")))
    rows = scripts.select(
        "system", "name", "path", sources.alias("source_tables"), targets.alias("target_tables"),
        kinds.alias("transformation_types"),
        contained_words("content", vocab.BUSINESS_TERMS).alias("business_keywords"),
        *([_paths(hadoop, databricks, LOAD_PATH, READ_PATH).alias("source_files"),
           _paths(hadoop, databricks, STORE_PATH, WRITE_PATH).alias("target_files")] if files else []))
    kept = SETS + FILES if files else SETS
    last = rows.groupBy("system", "name").agg(F.max_by(F.struct("path", *kept), "path").alias("r"))
    return last.select("system", "name", "r.*")


def classes(sigs: DataFrame, system: str) -> DataFrame:
    """Distinct signatures of one system: key, the four sets, number of workflows."""
    keyed = sigs.filter(F.col("system") == system).withColumn("key", set_key(*SETS))
    return keyed.groupBy("key").agg(*[F.first(c).alias(c) for c in SETS], F.count("*").alias("n"))


def members(sigs: DataFrame, system: str) -> DataFrame:
    return sigs.filter(F.col("system") == system).select(set_key(*SETS).alias("key"), "name", "path")


def hot_tables(left: DataFrame, right: DataFrame, hot_limit: int) -> DataFrame:
    """(role, table) used by more than `hot_limit` classes of either system."""
    refs = lambda df: df.select(F.explode(F.array(
        F.struct(F.lit("src").alias("role"), F.col("source_tables").alias("ts")),
        F.struct(F.lit("tgt").alias("role"), F.col("target_tables").alias("ts")))).alias("r")) \
        .select("r.role", F.explode("r.ts").alias("tab")).groupBy("role", "tab").agg(F.count("*").alias("c"))
    return refs(left).unionByName(refs(right)).groupBy("role", "tab").agg(F.max("c").alias("c")) \
        .filter(F.col("c") > hot_limit).select("role", "tab")


def _split_hot(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds hot_src, hot_tgt (sorted arrays) to classes."""
    refs = df.select("key", F.lit("src").alias("role"), F.explode("source_tables").alias("tab")).unionByName(
        df.select("key", F.lit("tgt").alias("role"), F.explode("target_tables").alias("tab")))
    pick = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("tab"))))
    found = refs.join(hot, ["role", "tab"]).groupBy("key").agg(
        pick("src").alias("hot_src"), pick("tgt").alias("hot_tgt"))
    none = F.array().cast("array<string>")
    return df.join(found, "key", "left").withColumn("hot_src", F.coalesce("hot_src", none)) \
        .withColumn("hot_tgt", F.coalesce("hot_tgt", none))


def _coarse(df: DataFrame) -> DataFrame:
    """Adds the cell key (logic and keyword sets) and the coarse key: cell, hot tables and, where hot tables exist, set sizes."""
    size = lambda hot, ts: F.when(F.size(hot) > 0, F.size(ts)).otherwise(0)
    df = df.withColumn("src_size", size("hot_src", "source_tables")) \
           .withColumn("tgt_size", size("hot_tgt", "target_tables"))
    return df.withColumn("cell", set_key("transformation_types", "business_keywords")).withColumn("coarse", set_key(
        "transformation_types", "business_keywords", "hot_src", "hot_tgt",
        F.array(F.col("src_size").cast("string"), F.col("tgt_size").cast("string"))))


def _overall(data, logic, business) -> Column:
    w = vocab.PAIR_WEIGHTS
    return F.round(data * w["data"] + logic * w["logic"] + business * w["business"], DIGITS)


def _pair(df: DataFrame, prefix: str, columns) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _prepared(sigs, source, target, hot_limit):
    left, right = classes(sigs, source), classes(sigs, target)
    hot = hot_tables(left, right, hot_limit)
    # every later step reads these two tables several times: compute them once
    return cut_lineage(_coarse(_split_hot(left, hot))), cut_lineage(_coarse(_split_hot(right, hot)))


SIMS = ["data_sim", "logic_sim", "business_sim", "overall_sim"]
_LOGIC = ["transformation_types", "business_keywords"]


def _met(left: DataFrame, right: DataFrame, key: str, sources: str | Column, targets: str | Column) -> DataFrame:
    """(s_<key>, t_<key>) of rows that share a table in the same role, each pair once: at the first hash that both hold.

    Only hashes travel. Two tables with one hash would let a pair be met too early, which its score does not care about.
    """
    hashed = lambda role, ts: F.transform(ts, lambda x: F.xxhash64(F.lit(role), x))
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_{key}"), F.concat(hashed("src", sources), hashed("tgt", targets)).alias(f"{p}_all")) \
        .select("*", F.explode(f"{p}_all").alias("ref"))
    return side(left, "s").join(side(right, "t"), "ref") \
        .where(F.col("ref") == F.array_min(F.array_intersect("s_all", "t_all"))).select(f"s_{key}", f"t_{key}")


def _scored(pairs: DataFrame, data: Column, threshold: float) -> DataFrame:
    pairs = pairs.withColumn("data_sim", data) \
        .withColumn("logic_sim", jaccard("s_transformation_types", "t_transformation_types")) \
        .withColumn("business_sim", jaccard("s_business_keywords", "t_business_keywords"))
    return pairs.withColumn("overall_sim", _overall(F.col("data_sim"), F.col("logic_sim"), F.col("business_sim"))) \
        .filter(F.col("overall_sim") >= threshold)


def _close_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Accepted class pairs that share a cold table, with exact scores."""
    keys = _met(left, right, "key", F.array_except("source_tables", "hot_src"), F.array_except("target_tables", "hot_tgt"))
    columns = ["key", "coarse", "cell", "n", *SETS]
    pairs = spread_pairs(keys).join(_pair(left, "s", columns), "s_key").join(_pair(right, "t", columns), "t_key")
    data = (jaccard("s_source_tables", "t_source_tables") + jaccard("s_target_tables", "t_target_tables")) / 2
    return _scored(pairs, data, threshold).select(*[f"{p}_{c}" for p in "st" for c in ("key", "coarse", "cell", "n")], *SIMS)


_COARSE_SETS = [*_LOGIC, "hot_src", "hot_tgt", "src_size", "tgt_size"]


def _hot_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Accepted coarse class pairs that share a hot table, scored without any cold table."""
    group = lambda df: df.groupBy("coarse").agg(F.first("cell").alias("cell"), *[F.first(c).alias(c) for c in _COARSE_SETS], F.sum("n").alias("total")) \
        .where((F.size("hot_src") > 0) | (F.size("hot_tgt") > 0))
    s, t = group(left), group(right)
    columns = ["coarse", "cell", "total", *_COARSE_SETS]
    pairs = spread_pairs(_met(s, t, "coarse", F.col("hot_src"), F.col("hot_tgt"))).join(_pair(s, "s", columns), "s_coarse").join(_pair(t, "t", columns), "t_coarse")

    def hot_jaccard(hot, size):
        shared = overlap(f"s_{hot}", f"t_{hot}")
        return F.when(shared > 0, shared / (F.col(f"s_{size}") + F.col(f"t_{size}") - shared)).otherwise(F.lit(0.0))

    data = (hot_jaccard("hot_src", "src_size") + hot_jaccard("hot_tgt", "tgt_size")) / 2
    return _scored(pairs, data, threshold).select(*[f"{p}_{c}" for p in "st" for c in ("coarse", "cell", "total")], *SIMS)


def _cell_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Accepted pairs of cells, scored without any table. Cells meet through the pairs of logic sets that can reach the threshold."""
    group = lambda df, p: df.groupBy(F.col("cell").alias(f"{p}_cell")).agg(
        *[F.first(c).alias(f"{p}_{c}") for c in _LOGIC], F.sum("n").alias(f"{p}_total")).withColumn(f"{p}_kinds", set_key(f"{p}_transformation_types"))
    s, t = group(left, "s"), group(right, "t")
    # logic sets are subsets of a fixed vocabulary of kinds: one short row holds all of a side
    kinds = lambda df, p: df.select(f"{p}_kinds", F.col(f"{p}_transformation_types").alias(f"{p}_set")).distinct()
    every = kinds(t, "t").agg(F.collect_list(F.struct("t_kinds", "t_set")).alias("every"))
    most = F.round(jaccard("s_set", "t_set") * vocab.PAIR_WEIGHTS["logic"] + vocab.PAIR_WEIGHTS["business"], DIGITS)
    able = kinds(s, "s").join(F.broadcast(every)).select("s_kinds", "s_set", F.inline("every")).where(most >= threshold).select("s_kinds", "t_kinds")
    pairs = s.join(F.broadcast(able), "s_kinds").join(t, "t_kinds")
    return _scored(pairs, F.lit(0.0), threshold).select(*[f"{p}_{c}" for p in "st" for c in ("cell", "total")], *SIMS)


_UNIT = 10 ** 12  # scores are added up in these parts, so sums and differences are exact


def _weighted(n: str, prefix: str, suffix: str = "") -> list[Column]:
    """Number of workflows and weighted score sums, as exact integers."""
    weight = F.col(n).cast("decimal(18,0)")
    return [F.sum(weight).alias(f"{prefix}_n"),
            *[F.sum(weight * F.round(F.col(c + suffix) * _UNIT).cast("decimal(15,0)")).alias(f"{prefix}_{c}") for c in SIMS]]


class PairTable:
    """The three layers of workflow pairs between two systems, accepted pairs only, computed once."""

    def __init__(self, sigs: DataFrame, source: str, target: str,
                 threshold: float = vocab.PAIR_THRESHOLD, hot_limit: int = 1000):
        if threshold <= 0:
            raise ValueError("the threshold must be positive")
        self.left, self.right = _prepared(sigs, source, target, hot_limit)
        self.close = cut_lineage(_close_pairs(self.left, self.right, threshold))
        self.hot = cut_lineage(_hot_pairs(self.left, self.right, threshold))
        self.cells = cut_lineage(_cell_pairs(self.left, self.right, threshold))
        #: pairs of groups of which every source is a partner of every target
        self.levels = {"cell": self.cells, "coarse": self.hot}

    def groups(self) -> DataFrame:
        """(data_sim, logic_sim, business_sim, overall_sim, n_pairs): all accepted pairs, counted by score."""
        product = lambda a, b: F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")
        close = self.close.select(*SIMS, product("s_n", "t_n").alias("n_pairs"))
        taken = self.close.groupBy("s_coarse", "t_coarse").agg(F.sum(product("s_n", "t_n")).alias("taken"))
        hot = self.hot.join(taken, ["s_coarse", "t_coarse"], "left") \
            .select("s_cell", "t_cell", *SIMS, product("s_total", "t_total").alias("whole"), F.coalesce("taken", F.lit(0)).alias("taken"))
        lone = self.close.join(self.hot, ["s_coarse", "t_coarse"], "left_anti").groupBy("s_cell", "t_cell").agg(F.sum(product("s_n", "t_n")).alias("n"))
        others = hot.groupBy("s_cell", "t_cell").agg(F.sum("whole").alias("n")).unionByName(lone).groupBy("s_cell", "t_cell").agg(F.sum("n").alias("others"))
        cells = self.cells.join(others, ["s_cell", "t_cell"], "left") \
            .select(*SIMS, (product("s_total", "t_total") - F.coalesce("others", F.lit(0))).alias("n_pairs"))
        return close.unionByName(hot.select(*SIMS, (F.col("whole") - F.col("taken")).alias("n_pairs"))).unionByName(cells) \
            .groupBy(*SIMS).agg(F.sum("n_pairs").cast("bigint").alias("n_pairs")).filter(F.col("n_pairs") > 0)

    def side_totals(self, side: str) -> DataFrame:
        """Per signature class of one side: partners, and exact sums of the four scores over them.

        Own cell, plus own coarse class, plus own close pairs; what a finer layer counts anew is taken back from the coarser one.
        """
        me, other = ("t", "s") if side == "target" else ("s", "t")
        own = self.right if side == "target" else self.left
        renamed = lambda df: df.select("s_cell", "t_cell", *[F.col(c).alias(f"{c}_cell") for c in SIMS])
        by = lambda df, key, n, prefix, suffix="": df.groupBy(F.col(f"{me}_{key}").alias(key)).agg(*_weighted(n, prefix, suffix))
        parts = [
            (by(self.cells, "cell", f"{other}_total", "a"), "cell", "a", 1),
            (by(self.hot, "coarse", f"{other}_total", "b"), "coarse", "b", 1),
            (by(self.hot.join(renamed(self.cells), ["s_cell", "t_cell"]), "coarse", f"{other}_total", "c", "_cell"), "coarse", "c", -1),
            (by(self.close, "key", f"{other}_n", "d"), "key", "d", 1),
            (by(self.close.drop(*SIMS).join(self.hot.select("s_coarse", "t_coarse", *SIMS), ["s_coarse", "t_coarse"]), "key", f"{other}_n", "e"), "key", "e", -1),
            (by(self.close.join(self.hot, ["s_coarse", "t_coarse"], "left_anti").join(renamed(self.cells), ["s_cell", "t_cell"]), "key", f"{other}_n", "f", "_cell"), "key", "f", -1),
        ]
        out = own.select("key", "coarse", "cell", F.col("n").alias("members"))
        for df, key, _, _ in parts:
            out = out.join(df, key, "left")
        total = lambda c: sum((F.coalesce(F.col(f"{p}_{c}"), F.lit(0)) * sign for _, _, p, sign in parts), F.lit(0))
        return out.select("key", "coarse", "cell", "members", total("n").cast("bigint").alias("partners"), *[total(c).cast("decimal(38,0)").alias(f"sum_{c}") for c in SIMS]) \
            .filter(F.col("partners") > 0)


def pair_similarity(sigs: DataFrame, source: str, target: str, threshold: float = vocab.PAIR_THRESHOLD,
                    hot_limit: int = 1000) -> DataFrame:
    """Accepted workflow pairs counted by their four scores; the same for every `hot_limit`."""
    return PairTable(sigs, source, target, threshold, hot_limit).groups()


def confidence(score) -> Column:
    return F.when(at_least(score, 0.7), "high").when(at_least(score, 0.5), "medium").otherwise("low")


SALTS = 64  # tasks that share the targets of one group


class Mappings:
    """Workflow mappings of one pair table, on signature classes.

    Joins by class carry a merge hint: rows of class tables are much larger than their files, by whose size a plan
    would send them through the driver.

    N:1: a target with several sources. 1:N: a source with several targets that is part of no
    N:1 mapping. 1:1: what remains. Rows stand for `members` workflows of the anchor class.

    Every source of an accepted cell or coarse pair is a partner of every target there (see the
    module), so relations between groups need no counts: cells first, coarse classes, close pairs.
    """

    def __init__(self, pairs: PairTable):
        self.pairs = pairs
        self.targets = cut_lineage(pairs.side_totals("target"))
        self.sources = cut_lineage(pairs.side_totals("source"))
        self.n1 = self.targets.filter(F.col("partners") > 1).select(*[F.col(c).alias(f"t_{c}") for c in ("key", "coarse", "cell")])
        # source classes that feed an N:1 target, through a close pair or a pair of groups
        used = pairs.close.join(self.n1.select("t_key"), "t_key", "left_semi").select(F.col("s_key").alias("key"))
        for level, found in pairs.levels.items():
            feeding = found.join(self.n1.select(f"t_{level}").distinct(), f"t_{level}", "left_semi").select(F.col(f"s_{level}").alias(level)).distinct()
            used = used.unionByName(self.sources.join(feeding, level, "left_semi").select("key"))
        self.used = cut_lineage(used.distinct())

    def free(self) -> DataFrame:
        """Source classes outside all N:1 mappings; each of their targets has one source."""
        return self.sources.join(self.used, "key", "left_anti")

    def rows(self) -> DataFrame:
        """One row per mapping class: kind, anchor side and key, members, partners, mean scores."""
        def means(df):
            return [F.round(F.col(f"sum_{c}").cast("double") / F.col("partners") / _UNIT, DIGITS).alias(c) for c in SIMS]
        n1 = self.targets.filter(F.col("partners") > 1).select(
            F.lit("N:1").alias("kind"), F.col("key").alias("target_key"), F.lit(None).cast("string").alias("source_key"),
            "members", F.col("partners").alias("n_sources"), F.lit(1).cast("bigint").alias("n_targets"), *means(self.targets))
        free = self.free()
        rest = free.select(
            F.when(F.col("partners") > 1, "1:N").otherwise("1:1").alias("kind"),
            F.lit(None).cast("string").alias("target_key"), F.col("key").alias("source_key"), "members",
            F.lit(1).cast("bigint").alias("n_sources"), F.col("partners").alias("n_targets"), *means(free))
        return n1.unionByName(rest).withColumn("confidence", confidence("overall_sim"))

    def outputs(self) -> tuple[dict[str, DataFrame], DataFrame]:
        """Tables written by the sources of N:1 targets, without a list per target.

        First, per level (t_cell, tab) and (t_coarse, tab): tables all targets of a group receive, at
        the coarsest level only. Second (t_key, tab): tables a target receives on top of that through close pairs.
        """
        p = self.pairs
        groups = self.n1.select("t_coarse", "t_cell").distinct()
        offered: dict[str, DataFrame] = {}
        for level, found in p.levels.items():
            writes = p.left.select(F.col(level).alias(f"s_{level}"), F.explode("target_tables").alias("tab")).distinct()
            rows = found.select(f"s_{level}", f"t_{level}").join(groups.select(f"t_{level}").distinct(), f"t_{level}", "left_semi") \
                .join(writes, f"s_{level}").select(f"t_{level}", "tab").distinct()
            if level == "coarse":
                rows = rows.join(groups, "t_coarse").join(offered["cell"], ["t_cell", "tab"], "left_anti").select("t_coarse", "tab")
            offered[level] = cut_lineage(rows)
        own = p.left.select(F.col("key").alias("s_key"), F.explode("target_tables").alias("tab")).hint("merge")
        extra = p.close.select("s_key", "t_key").join(self.n1.hint("merge"), "t_key").join(own, "s_key").select("t_key", "t_coarse", "t_cell", "tab").distinct()
        for level, rows in offered.items():
            extra = extra.join(rows.hint("merge"), [f"t_{level}", "tab"], "left_anti")
        return offered, extra.select("t_key", "tab")

    def _target_tables(self, offered: dict[str, DataFrame], extra: DataFrame) -> DataFrame:
        """Own tables of N:1 targets (use = read | write) with a flag: some source writes them."""
        out = self.pairs.right.select(F.col("key").alias("t_key"), F.explode(F.concat(
            F.transform("source_tables", lambda x: F.struct(F.lit("read").alias("use"), x.alias("tab"))),
            F.transform("target_tables", lambda x: F.struct(F.lit("write").alias("use"), x.alias("tab"))))).alias("o")) \
            .select("t_key", "o.*").join(self.n1.hint("merge"), "t_key")
        for level, rows in offered.items():
            out = out.join(rows.withColumn(f"in_{level}", F.lit(True)).hint("merge"), [f"t_{level}", "tab"], "left")
        out = out.join(extra.withColumn("in_extra", F.lit(True)), ["t_key", "tab"], "left")
        return out.select("t_key", "use", "tab", F.coalesce("in_cell", "in_coarse", "in_extra", F.lit(False)).alias("received"))

    def _free_tables(self) -> DataFrame:
        """(kind, anchor_key, tab, relation) of 1:N and 1:1 mappings."""
        p = self.pairs
        tabs = lambda df, col, key: df.select(F.col("key").alias(key), F.explode(col).alias("tab")).hint("merge")
        free = self.free().select(*[F.col(c).alias(f"s_{c}") for c in ("key", "coarse", "cell")],
                                  F.when(F.col("partners") > 1, "1:N").otherwise("1:1").alias("kind"))
        edges = p.close.select("s_key", "t_key").join(free.select("s_key", "kind"), "s_key").select("s_key", "t_key", "kind")
        for level, found in p.levels.items():
            edges = edges.unionByName(free.join(found.select(f"s_{level}", f"t_{level}"), f"s_{level}").join(
                p.right.select(F.col("key").alias("t_key"), F.col(level).alias(f"t_{level}")), f"t_{level}").select("s_key", "t_key", "kind"))
        edges = edges.distinct()
        of_targets = lambda col: edges.join(tabs(p.right, col, "t_key"), "t_key").select("s_key", "kind", "tab").distinct()
        of_source = lambda col: free.select("s_key", "kind").join(tabs(p.left, col, "s_key"), "s_key")
        on = ["s_key", "kind", "tab"]
        t_writes = of_targets("target_tables")
        s_writes = of_source("target_tables")
        rel = lambda df, name: df.select("kind", F.col("s_key").alias("anchor_key"), "tab", F.lit(name).alias("relation"))
        return rel(of_source("source_tables").join(of_targets("source_tables"), on, "left_semi"), "shared") \
            .unionByName(rel(s_writes.join(t_writes, on, "left_anti"), "missing")) \
            .unionByName(rel(t_writes.join(s_writes, on, "left_anti"), "added"))

    def table_diff(self) -> DataFrame:
        """Shared and added tables of every mapping, missing tables of 1:N and 1:1 mappings.

        N:1 compares the sources' outputs with the target; 1:N and 1:1 compare like with like.
        The missing tables of N:1 mappings would repeat per target what its class receives:
        see `table_counts`, `missing_tables` and, for chosen mappings, `expand_missing`.
        """
        own = self._target_tables(*self.outputs())
        row = lambda df, name: df.select(F.lit("N:1").alias("kind"), F.col("t_key").alias("anchor_key"), "tab", F.lit(name).alias("relation"))
        return row(own.filter((F.col("use") == "read") & F.col("received")), "shared") \
            .unionByName(row(own.filter((F.col("use") == "write") & ~F.col("received")), "added")) \
            .unionByName(self._free_tables())

    def table_counts(self) -> DataFrame:
        """Numbers of shared, missing and added tables per mapping class."""
        offered, extra = self.outputs()
        is_write = F.col("use") == "write"
        own = self._target_tables(offered, extra).groupBy("t_key").agg(
            F.count_if((F.col("use") == "read") & F.col("received")).alias("n_shared"),
            F.count_if(is_write & F.col("received")).alias("kept"), F.count_if(is_write & ~F.col("received")).alias("n_added"))
        n1 = self.n1
        for level, rows in offered.items():
            n1 = n1.join(rows.groupBy(f"t_{level}").agg(F.count("*").alias(f"of_{level}")), f"t_{level}", "left")
        n1 = n1.join(extra.groupBy("t_key").agg(F.count("*").alias("of_extra")), "t_key", "left").join(own, "t_key", "left") \
            .fillna(0, ["of_cell", "of_coarse", "of_extra", "n_shared", "kept", "n_added"])
        n1 = n1.select(F.lit("N:1").alias("kind"), F.col("t_key").alias("anchor_key"), "n_shared",
                       (F.col("of_cell") + F.col("of_coarse") + F.col("of_extra") - F.col("kept")).alias("n_missing"), "n_added")
        counted = self._free_tables().groupBy("anchor_key").agg(*[
            F.count_if(F.col("relation") == r).alias(f"n_{r}") for r in ("shared", "missing", "added")])
        free = self.free().select(F.when(F.col("partners") > 1, "1:N").otherwise("1:1").alias("kind"), F.col("key").alias("anchor_key")) \
            .join(counted, "anchor_key", "left").fillna(0, ["n_shared", "n_missing", "n_added"])
        return n1.unionByName(free.select(*n1.columns))

    def missing_tables(self) -> DataFrame:
        """Distinct tables that some mapping misses in its target."""
        offered, extra = self.outputs()
        writes = self.pairs.right.select(F.col("key").alias("t_key"), F.explode("target_tables").alias("tab")).join(self.n1, "t_key")
        missed = self._free_tables().filter(F.col("relation") == "missing").select("tab")
        for level, rows in offered.items():
            group = f"t_{level}"
            size = self.n1.groupBy(group).agg(F.count("*").alias("targets"))
            writers = writes.groupBy(group, "tab").agg(F.count("*").alias("writers"))
            missed = missed.unionByName(rows.join(size, group).join(writers, [group, "tab"], "left")
                                        .filter(F.coalesce("writers", F.lit(0)) < F.col("targets")).select("tab"))
        by_extra = extra.join(writes.select("t_key", "tab"), ["t_key", "tab"], "left_anti").select("tab")
        return missed.unionByName(by_extra).distinct()

    def expand_missing(self, anchors: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Missing tables of chosen N:1 mappings (column `anchor_key`), as rows, with the columns `keep` of `anchors`.

        The list grows with targets times tables, so nothing is joined to it: what a target writes itself and what is
        kept of its anchors come in before its tables are listed. Targets of a group are dealt to SALTS tasks.
        """
        offered, extra = self.outputs()
        own = self.pairs.right.select(F.col("key").alias("t_key"), F.col("target_tables").alias("own")).hint("merge")
        named = anchors.select(F.col("anchor_key").alias("t_key"), *keep)
        chosen = self.n1.join(own, "t_key").join((named if keep else named.distinct()).hint("merge"), "t_key")
        columns = ["t_key", *keep, "own", "tab"]
        rows = chosen.join(extra.hint("merge"), "t_key").select(*columns)
        dealt = chosen.withColumn("salt", F.pmod(F.xxhash64("t_key"), F.lit(SALTS)))
        for level, found in offered.items():
            every = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            rows = rows.unionByName(dealt.join(every.hint("merge"), [f"t_{level}", "salt"]).select(*columns))
        return rows.filter(~F.coalesce(F.array_contains("own", F.col("tab")), F.lit(False))).select(
            F.lit("N:1").alias("kind"), F.col("t_key").alias("anchor_key"), *keep, "tab", F.lit("missing").alias("relation"))

    def mapped(self, side: str) -> DataFrame:
        """Signature classes of one side with at least one partner."""
        return (self.targets if side == "target" else self.sources).select("key", "members")


def group_mappings(sigs: DataFrame, source: str, target: str, threshold: float = vocab.PAIR_THRESHOLD,
                   hot_limit: int = 1000) -> Mappings:
    return Mappings(PairTable(sigs, source, target, threshold, hot_limit))


def mapping_table(mappings: Mappings, sigs: DataFrame, source: str, target: str) -> DataFrame:
    """One row per mapping with the workflow name of its anchor."""
    rows = mappings.rows().withColumn("anchor_key", F.coalesce("target_key", "source_key")) \
        .withColumn("anchor_side", F.when(F.col("kind") == "N:1", "target").otherwise("source"))
    names = members(sigs, source).withColumn("anchor_side", F.lit("source")).unionByName(
        members(sigs, target).withColumn("anchor_side", F.lit("target")))
    return rows.join(names.withColumnRenamed("key", "anchor_key"), ["anchor_key", "anchor_side"]) \
        .select("kind", "anchor_side", F.col("name").alias("anchor"), "n_sources", "n_targets", *SIMS, "confidence")


def mapping_stats(rows: DataFrame) -> DataFrame:
    """Counts of mappings by confidence and kind, with subtotals."""
    return rows.cube("confidence", "kind").agg(F.sum("members").alias("mappings"))


def mappings_of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """N:1, 1:N or 1:1 by comparing the counts of sources and targets."""
    many_s, many_t = F.col("n_sources") > 1, F.col("n_targets") > 1
    test = {"N:1": many_s, "1:N": many_t, "1:1": ~many_s & ~many_t}[kind]
    return rows.filter(test)


def logic_similarity(pairs: DataFrame, left="s", right="t") -> DataFrame:
    """Weighted overlap of transformations, tables and rules, scaled to the parts that exist.

    A boost of up to 0.2 rewards transformations equal or containing each other after
    normalising; the result is at most 1. Arrays: <side>_transformations, _tables, _rules.
    """
    w = vocab.LOGIC_WEIGHTS
    low = lambda c: F.array_distinct(F.transform(c, lambda x: F.lower(x)))
    side = lambda c: (low(f"{left}_{c}"), low(f"{right}_{c}"))
    score, total = F.lit(0.0), F.lit(0.0)
    for part in ("transformations", "tables", "rules"):
        a, b = side(part)
        used = (F.size(a) > 0) | (F.size(b) > 0)
        value = overlap(a, b) / F.greatest(F.size(a), F.size(b), F.lit(1)) if part == "tables" else jaccard(a, b)
        score = score + F.when(used, value * w[part]).otherwise(0.0)
        total = total + F.when(used, w[part]).otherwise(0.0)
    base = F.when(total > 0, score / total).otherwise(0.0)
    na = F.transform(f"{left}_transformations", normal_transformation)
    nb = F.transform(f"{right}_transformations", normal_transformation)
    fuzzy = F.size(F.filter(na, lambda x: F.exists(nb, lambda y: (x == y) | y.contains(x) | x.contains(y))))
    boost = F.when((F.size(na) > 0) & (F.size(nb) > 0),
                   fuzzy / F.greatest(F.size(na), F.size(nb), F.lit(1)) * 0.2).otherwise(0.0)
    return pairs.withColumn("logic_score", F.least(base + boost, F.lit(1.0)))


def migration_report(mappings: Mappings, sigs: DataFrame, source: str, target: str) -> DataFrame:
    """One row: workflow totals, mapped, unmapped, completeness and mapping counts."""
    total = lambda system, name: sigs.agg(F.count_if(F.col("system") == system).alias(name))
    mapped = lambda side, name: mappings.mapped(side).agg(F.coalesce(F.sum("members"), F.lit(0)).alias(name))
    rows = mappings.rows()
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("members"))), F.lit(0))
    counts = rows.agg(
        *[n(F.col("confidence") == c).alias(f"{c}_confidence") for c in ("high", "medium", "low")],
        n(F.col("kind") == "1:1").alias("one_to_one"), n(F.col("kind") == "N:1").alias("n_to_one"),
        n(F.col("kind") == "1:N").alias("one_to_n"))
    # each input is an aggregate of one row
    out = total(source, "source_workflows").crossJoin(total(target, "target_workflows")) \
        .crossJoin(mapped("source", "mapped_sources")).crossJoin(mapped("target", "mapped_targets")).crossJoin(counts)
    done = F.when(F.col("source_workflows") > 0, F.col("mapped_sources") / F.col("source_workflows") * 100).otherwise(0.0)
    return out.withColumn("unmapped_sources", F.col("source_workflows") - F.col("mapped_sources")) \
        .withColumn("unmapped_targets", F.col("target_workflows") - F.col("mapped_targets")) \
        .withColumn("completeness", done)


def migration_gaps(mappings: Mappings, sigs: DataFrame, source: str, target: str) -> DataFrame:
    """Unmapped workflows of both sides and low-confidence mappings, with severity and rank."""
    keyed = sigs.withColumn("key", set_key(*SETS))
    unmapped = lambda system, side: keyed.filter(F.col("system") == system).join(
        mappings.mapped(side), "key", "left_anti")
    critical = F.exists("business_keywords", lambda k: k.isin(*vocab.CRITICAL_TERMS))
    src = unmapped(source, "source").select(
        "system", F.col("name").alias("workflow"), F.lit("unmapped_source").alias("gap_type"),
        F.when(critical, "critical").when(F.size("business_keywords") == 0, "medium").otherwise("high").alias("severity"))
    tgt = unmapped(target, "target").select(
        "system", F.col("name").alias("workflow"), F.lit("unmapped_target").alias("gap_type"), F.lit("low").alias("severity"))
    weak = mapping_table(mappings, sigs, source, target).filter(F.col("confidence") == "low").select(
        F.lit("mapping").alias("system"), F.col("anchor").alias("workflow"),
        F.lit("partial_mapping").alias("gap_type"), F.lit("medium").alias("severity"))
    return order_by_severity(src.unionByName(tgt).unionByName(weak))


def severity_rank(severity="severity") -> Column:
    rank = F.lit(99)
    for i, s in reversed(list(enumerate(vocab.SEVERITIES))):
        rank = F.when(F.col(severity) == s, i).otherwise(rank)
    return rank


def order_by_severity(gaps: DataFrame) -> DataFrame:
    """Adds the severity rank; sort on it when writing (range partitions, no single task)."""
    return gaps.withColumn("severity_rank", severity_rank())


def migration_recommendations(report: DataFrame, critical_gaps: DataFrame, missing_tables: DataFrame) -> DataFrame:
    """Recommendation rows from completeness, mapping counts and gaps.

    `critical_gaps` and `missing_tables` are DataFrames of one row with column `n`.
    """
    row = report.crossJoin(critical_gaps.select(F.col("n").alias("critical"))) \
                .crossJoin(missing_tables.select(F.col("n").alias("missing")))
    done = F.col("completeness")
    item = lambda cond, code, value: F.when(cond, F.struct(F.lit(code).alias("code"), value.cast("double").alias("value")))
    items = F.array_compact(F.array(
        item(done < 70, "incomplete", done), item((done >= 70) & (done < 90), "nearly_complete", done),
        item(done >= 90, "complete", done),
        item(F.col("low_confidence") > 0, "low_confidence", F.col("low_confidence")),
        item(F.col("n_to_one") > 0, "consolidation", F.col("n_to_one")),
        item(F.col("one_to_n") > 0, "splitting", F.col("one_to_n")),
        item(F.col("critical") > 0, "critical_unmapped", F.col("critical")),
        item(F.col("missing") > 0, "missing_tables", F.col("missing"))))
    return row.select(F.explode(items).alias("i")).select("i.*")


def mappings_for(mappings: Mappings, sigs: DataFrame, source: str, target: str, text: str) -> DataFrame:
    """Mappings with a workflow whose name contains the text, on either side.

    Only the workflows that fit the name are expanded to their partners' anchors.
    """
    p = mappings.pairs
    fits = lambda system: members(sigs, system).filter(F.lower("name").contains(text.lower()))
    keys = lambda system, own: fits(system).select("key").distinct().join(own.select("key", "coarse", "cell"), "key")
    hit_s, hit_t = keys(source, p.left), keys(target, p.right)
    pick = lambda df, c: df.select(F.col(c).alias("key"))
    reached = lambda found, level, hits, me, other: found.join(hits.select(F.col(level).alias(f"{me}_{level}")).distinct(), f"{me}_{level}", "left_semi") \
        .select(f"{other}_{level}").distinct()
    # sources that fit: the N:1 targets they feed, else their own row
    fed = pick(p.close.join(pick(hit_s, "key").withColumnRenamed("key", "s_key"), "s_key", "left_semi"), "t_key")
    # targets that fit: their own N:1 row, else the free source they hang on
    free = mappings.free().select(*[F.col(c).alias(f"s_{c}") for c in ("key", "coarse", "cell")])
    hung = pick(p.close.join(hit_t.select(F.col("key").alias("t_key")), "t_key", "left_semi").join(free, "s_key", "left_semi"), "s_key")
    for level, found in p.levels.items():
        fed = fed.unionByName(pick(mappings.n1.join(reached(found, level, hit_s, "s", "t"), f"t_{level}", "left_semi"), "t_key"))
        hung = hung.unionByName(pick(free.join(reached(found, level, hit_t, "t", "s"), f"s_{level}", "left_semi"), "s_key"))
    fed = fed.distinct().join(pick(mappings.n1, "t_key"), "key", "left_semi")
    hung = hung.distinct()
    named = lambda df, side, matched: df.select(F.col("name").alias("anchor")).distinct() \
        .withColumn("anchor_side", F.lit(side)).withColumn("matched_side", F.lit(matched))
    hits = named(members(sigs, target).join(fed, "key"), "target", "source") \
        .unionByName(named(fits(source), "source", "source")).unionByName(named(fits(target), "target", "target")) \
        .unionByName(named(members(sigs, source).join(hung, "key"), "source", "target"))
    return mapping_table(mappings, sigs, source, target).join(hits, ["anchor", "anchor_side"])
