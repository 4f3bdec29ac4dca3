"""Registered queries for process matching and workflow mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions import vocab
from estatelens.functions.scale import cut_lineage, join_spread
from estatelens.functions.sets import name_tokens
from estatelens.functions.text import clean_table, contained_words, normal_name, short_id
from estatelens.operators import matching as mt
from estatelens.operators import workflow_mapping as wm
from estatelens.plans.registry import lit, lit_list, query
from estatelens.plans.views import view

SRC, TGT = "hadoop", "databricks"


def jac(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / {both} END"


def kw(text: str, words) -> str:
    return f"list_sort(list_filter({lit_list(words)}, lambda w: contains(lower({text}), w)))"


_found = lambda p: f"regexp_extract_all(content, {lit(p)}, 1)"
_low = lambda e: f"list_sort(list_distinct(list_transform({e}, lambda x: lower(x))))"

# Signatures, all pairs by brute force, and the mapping rules, for comparison only.
SIG = f"""
sig AS (SELECT system, name, path,
  CASE system WHEN 'hadoop' THEN {_low(_found(wm.FROM_NAME))} WHEN 'databricks' THEN {_low(f"list_concat({_found(wm.READ_TABLE)}, {_found(wm.FROM_NAME)})")} ELSE [] END AS st,
  CASE system WHEN 'hadoop' THEN {_low(_found(wm.INSERT_NAME))} WHEN 'databricks' THEN {_low(_found(wm.SAVE_TABLE))} ELSE [] END AS tt,
  list_filter(CASE system
    WHEN 'hadoop' THEN [CASE WHEN contains(upper(content), 'FILTER') THEN 'filter' END, CASE WHEN contains(upper(content), 'GROUP') THEN 'group_by' END, CASE WHEN contains(upper(content), 'JOIN') THEN 'join' END]
    WHEN 'databricks' THEN [CASE WHEN contains(lower(content), '.filter(') OR contains(lower(content), '.where(') THEN 'filter' END, CASE WHEN contains(lower(content), '.groupby(') THEN 'group_by' END, CASE WHEN contains(lower(content), '.join(') THEN 'join' END]
    ELSE [] END, lambda x: x IS NOT NULL) AS kinds,
  {kw('content', vocab.BUSINESS_TERMS)} AS kws FROM scripts)"""
ALL_PAIRS = f"""
scored AS (SELECT s.name AS sname, t.name AS tname, s.st AS s_st, s.tt AS s_tt, t.st AS t_st, t.tt AS t_tt,
  ({jac('s.st', 't.st')} + {jac('s.tt', 't.tt')}) / 2 AS data_sim, {jac('s.kinds', 't.kinds')} AS logic_sim, {jac('s.kws', 't.kws')} AS business_sim
  FROM sig s JOIN sig t ON s.system = 'hadoop' AND t.system = 'databricks'),
p AS (SELECT *, round(data_sim * 0.5::DOUBLE + logic_sim * 0.3::DOUBLE + business_sim * 0.2::DOUBLE, 9) AS overall_sim FROM scored
  WHERE round(data_sim * 0.5::DOUBLE + logic_sim * 0.3::DOUBLE + business_sim * 0.2::DOUBLE, 9) >= 0.3)"""
MAPS = """
many AS (SELECT tname FROM p GROUP BY tname HAVING count(*) > 1),
used AS (SELECT DISTINCT sname FROM p JOIN many USING (tname)),
maps AS (
  SELECT 'N:1' AS kind, 'target' AS anchor_side, tname AS anchor, count(*) AS n_sources, CAST(1 AS BIGINT) AS n_targets,
    round(avg(data_sim), 6) AS data_sim, round(avg(logic_sim), 6) AS logic_sim, round(avg(business_sim), 6) AS business_sim, round(avg(overall_sim), 6) AS overall_sim,
    CASE WHEN round(avg(overall_sim), 9) >= 0.7 THEN 'high' WHEN round(avg(overall_sim), 9) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
  FROM p JOIN many USING (tname) GROUP BY tname
  UNION ALL SELECT CASE WHEN count(*) > 1 THEN '1:N' ELSE '1:1' END, 'source', sname, 1, count(*),
    round(avg(data_sim), 6), round(avg(logic_sim), 6), round(avg(business_sim), 6), round(avg(overall_sim), 6),
    CASE WHEN round(avg(overall_sim), 9) >= 0.7 THEN 'high' WHEN round(avg(overall_sim), 9) >= 0.5 THEN 'medium' ELSE 'low' END
  FROM p WHERE sname NOT IN (SELECT sname FROM used) GROUP BY sname)"""
DIFFS = """
outs AS (SELECT DISTINCT tname, unnest(s_tt) AS tab FROM p JOIN many USING (tname)),
t_in AS (SELECT DISTINCT tname, unnest(t_st) AS tab FROM p JOIN many USING (tname)),
t_out AS (SELECT DISTINCT tname, unnest(t_tt) AS tab FROM p JOIN many USING (tname)),
fp AS (SELECT * FROM p WHERE sname NOT IN (SELECT sname FROM used)),
fk AS (SELECT sname, CASE WHEN count(*) > 1 THEN '1:N' ELSE '1:1' END AS kind FROM fp GROUP BY sname),
f_ti AS (SELECT DISTINCT sname, unnest(t_st) AS tab FROM fp), f_to AS (SELECT DISTINCT sname, unnest(t_tt) AS tab FROM fp),
f_si AS (SELECT DISTINCT sname, unnest(s_st) AS tab FROM fp), f_so AS (SELECT DISTINCT sname, unnest(s_tt) AS tab FROM fp),
diffs AS (
  SELECT 'N:1' AS kind, tname AS anchor, tab, 'shared' AS relation FROM (SELECT * FROM outs INTERSECT SELECT * FROM t_in) a
  UNION ALL SELECT 'N:1', tname, tab, 'missing' FROM (SELECT * FROM outs EXCEPT SELECT * FROM t_out) b
  UNION ALL SELECT 'N:1', tname, tab, 'added' FROM (SELECT * FROM t_out EXCEPT SELECT * FROM outs) c
  UNION ALL SELECT kind, sname, tab, 'shared' FROM (SELECT * FROM f_si INTERSECT SELECT * FROM f_ti) d JOIN fk USING (sname)
  UNION ALL SELECT kind, sname, tab, 'missing' FROM (SELECT * FROM f_so EXCEPT SELECT * FROM f_to) e JOIN fk USING (sname)
  UNION ALL SELECT kind, sname, tab, 'added' FROM (SELECT * FROM f_to EXCEPT SELECT * FROM f_so) g JOIN fk USING (sname))"""
REPORT = """
rep AS (SELECT (SELECT count(*) FROM sig WHERE system = 'hadoop') AS source_workflows, (SELECT count(*) FROM sig WHERE system = 'databricks') AS target_workflows,
  (SELECT count(DISTINCT sname) FROM p) AS mapped_sources, (SELECT count(DISTINCT tname) FROM p) AS mapped_targets,
  (SELECT count(*) FROM maps WHERE confidence = 'high') AS high_confidence, (SELECT count(*) FROM maps WHERE confidence = 'medium') AS medium_confidence,
  (SELECT count(*) FROM maps WHERE confidence = 'low') AS low_confidence, (SELECT count(*) FROM maps WHERE kind = '1:1') AS one_to_one,
  (SELECT count(*) FROM maps WHERE kind = 'N:1') AS n_to_one, (SELECT count(*) FROM maps WHERE kind = '1:N') AS one_to_n)"""
WF_GAPS = """
wf_gaps AS (
  SELECT system, name AS workflow, 'unmapped_source' AS gap_type, CASE WHEN len(list_intersect(kws, ['patient', 'eligibility', 'commercial', 'medicaid'])) > 0 THEN 'critical' WHEN len(kws) = 0 THEN 'medium' ELSE 'high' END AS severity
  FROM sig WHERE system = 'hadoop' AND name NOT IN (SELECT sname FROM p)
  UNION ALL SELECT system, name, 'unmapped_target', 'low' FROM sig WHERE system = 'databricks' AND name NOT IN (SELECT tname FROM p)
  UNION ALL SELECT 'mapping', anchor, 'partial_mapping', 'medium' FROM maps WHERE confidence = 'low')"""


def sigs(spark, folder):
    return wm.signatures(view(spark, folder, "scripts"))


def maps(spark, folder):
    all_sigs = cut_lineage(sigs(spark, folder))  # the script texts are read once
    return wm.group_mappings(all_sigs, SRC, TGT), all_sigs


@query("signatures", views=("scripts",), oracle=f"""
WITH {SIG} SELECT system, name, path, array_to_string(st, '|') AS source_tables, array_to_string(tt, '|') AS target_tables,
  array_to_string(kinds, '|') AS transformation_types, array_to_string(kws, '|') AS business_keywords FROM sig
""")
def signatures(spark, folder):
    return sigs(spark, folder)


@query("signature_files", views=("scripts",), oracle="""
SELECT CASE system WHEN 'databricks' THEN system ELSE 'hadoop' END AS system, name, path,
  CASE system WHEN 'databricks' THEN concat('/in/', regexp_extract(content, '(src_\\w+)', 1)) WHEN 'abinitio' THEN regexp_extract(content, '(src_\\w+)', 1) ELSE '' END AS source_files,
  CASE system WHEN 'databricks' THEN concat('/out/', regexp_extract(content, '(tgt_\\w+)', 1)) WHEN 'abinitio' THEN regexp_extract(content, '(tgt_\\w+)', 1) ELSE '' END AS target_files FROM scripts
""")
def signature_files(spark, folder):
    """Paths that Pig scripts load and store, and that PySpark scripts read and write as files."""
    text = F.replace("content", F.lit('read.table("'), F.lit('read.parquet("/in/'))
    text = F.replace(text, F.lit('.saveAsTable("'), F.lit('.save("/out/'))
    scripts = view(spark, folder, "scripts").withColumn("content", text) \
        .withColumn("system", F.when(F.col("system") == "abinitio", "hadoop").otherwise(F.col("system")))
    return wm.signatures(scripts, files=True).select("system", "name", "path", *wm.FILES)


@query("pair_similarity", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS}
SELECT round(data_sim, 6) AS data_sim, round(logic_sim, 6) AS logic_sim, round(business_sim, 6) AS business_sim, round(overall_sim, 6) AS overall_sim, count(*) AS n_pairs
FROM p GROUP BY 1, 2, 3, 4
""")
def pair_similarity(spark, folder):
    """Workflow pairs at or above the threshold, counted per score."""
    groups = wm.pair_similarity(cut_lineage(sigs(spark, folder)), SRC, TGT)
    rounded = [F.round(c, 6).alias(c) for c in wm.SIMS]
    return groups.select(*rounded, "n_pairs").groupBy(*wm.SIMS).agg(F.sum("n_pairs").alias("n_pairs"))


@query("pair_similarity_hot", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS}
SELECT round(data_sim, 6) AS data_sim, round(logic_sim, 6) AS logic_sim, round(business_sim, 6) AS business_sim, round(overall_sim, 6) AS overall_sim, count(*) AS n_pairs
FROM p GROUP BY 1, 2, 3, 4
""")
def pair_similarity_hot(spark, folder):
    """The same pairs with nearly all tables taken as hot: no row depends on the limit."""
    groups = wm.pair_similarity(cut_lineage(sigs(spark, folder)), SRC, TGT, hot_limit=2)
    rounded = [F.round(c, 6).alias(c) for c in wm.SIMS]
    return groups.select(*rounded, "n_pairs").groupBy(*wm.SIMS).agg(F.sum("n_pairs").alias("n_pairs"))


@query("group_mappings", views=("scripts",), oracle=f"WITH {SIG},{ALL_PAIRS},{MAPS} SELECT * FROM maps")
def group_mappings(spark, folder):
    m, all_sigs = maps(spark, folder)
    return wm.mapping_table(m, all_sigs, SRC, TGT)


def anchors(all_sigs):
    """Workflow names of both sides by kind of mapping they can anchor."""
    side = lambda system, kinds: wm.members(all_sigs, system).select(
        F.col("key").alias("anchor_key"), F.col("name").alias("anchor"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return side(TGT, ["N:1"]).unionByName(side(SRC, ["1:N", "1:1"]))


@query("mapping_table_diff", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{DIFFS} SELECT * FROM diffs
""")
def mapping_table_diff(spark, folder):
    m, all_sigs = maps(spark, folder)
    named = anchors(all_sigs).hint("merge")  # as many as workflows: never through the driver
    columns = ["kind", "anchor", "tab", "relation"]
    diff = m.table_diff().join(named, ["anchor_key", "kind"]).select(*columns)
    every = named.filter(F.col("kind") == "N:1").select("anchor_key", "anchor")
    return diff.unionByName(m.expand_missing(every, keep=("anchor",)).select(*columns))


@query("mapping_table_counts", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{DIFFS} SELECT m.kind, m.anchor, count(*) FILTER (relation = 'shared') AS n_shared, count(*) FILTER (relation = 'missing') AS n_missing, count(*) FILTER (relation = 'added') AS n_added
FROM maps m LEFT JOIN diffs d ON d.kind = m.kind AND d.anchor = m.anchor GROUP BY 1, 2
""")
def mapping_table_counts(spark, folder):
    m, all_sigs = maps(spark, folder)
    return m.table_counts().join(anchors(all_sigs), ["anchor_key", "kind"]).select("kind", "anchor", "n_shared", "n_missing", "n_added")


@query("missing_output_tables", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{DIFFS} SELECT DISTINCT tab FROM diffs WHERE relation = 'missing'
""")
def missing_output_tables(spark, folder):
    return maps(spark, folder)[0].missing_tables()


@query("mapping_stats", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS} SELECT confidence, kind, count(*) AS mappings FROM maps GROUP BY CUBE (confidence, kind)
""")
def mapping_stats(spark, folder):
    return wm.mapping_stats(maps(spark, folder)[0].rows())


@query("migration_report", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{REPORT}
SELECT *, source_workflows - mapped_sources AS unmapped_sources, target_workflows - mapped_targets AS unmapped_targets,
  round(CAST(mapped_sources AS DOUBLE) / source_workflows * 100, 6) AS completeness FROM rep
""")
def migration_report(spark, folder):
    m, all_sigs = maps(spark, folder)
    return wm.migration_report(m, all_sigs, SRC, TGT)


@query("migration_gaps", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{WF_GAPS}
SELECT *, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank FROM wf_gaps
""")
def migration_gaps(spark, folder):
    m, all_sigs = maps(spark, folder)
    return wm.migration_gaps(m, all_sigs, SRC, TGT)


@query("migration_recommendations", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},{REPORT},{WF_GAPS},{DIFFS},
r AS (SELECT *, CAST(mapped_sources AS DOUBLE) / source_workflows * 100 AS done,
  (SELECT count(*) FROM wf_gaps WHERE severity = 'critical') AS critical, (SELECT count(DISTINCT tab) FROM diffs WHERE relation = 'missing') AS missing FROM rep)
SELECT CASE WHEN done < 70 THEN 'incomplete' WHEN done < 90 THEN 'nearly_complete' ELSE 'complete' END AS code, round(done, 6) AS value FROM r
UNION ALL SELECT 'low_confidence', CAST(low_confidence AS DOUBLE) FROM r WHERE low_confidence > 0
UNION ALL SELECT 'consolidation', CAST(n_to_one AS DOUBLE) FROM r WHERE n_to_one > 0
UNION ALL SELECT 'splitting', CAST(one_to_n AS DOUBLE) FROM r WHERE one_to_n > 0
UNION ALL SELECT 'critical_unmapped', CAST(critical AS DOUBLE) FROM r WHERE critical > 0
UNION ALL SELECT 'missing_tables', CAST(missing AS DOUBLE) FROM r WHERE missing > 0
""")
def migration_recommendations(spark, folder):
    m, all_sigs = maps(spark, folder)
    critical = wm.migration_gaps(m, all_sigs, SRC, TGT).agg(F.count_if(F.col("severity") == "critical").alias("n"))
    missing = m.missing_tables().agg(F.count("*").alias("n"))
    return wm.migration_recommendations(wm.migration_report(m, all_sigs, SRC, TGT), critical, missing)


@query("mappings_of_kind", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS} SELECT kind, anchor, n_sources, n_targets, confidence FROM maps WHERE n_targets > 1
""")
def mappings_of_kind(spark, folder):
    m, all_sigs = maps(spark, folder)
    return wm.mappings_of_kind(wm.mapping_table(m, all_sigs, SRC, TGT), "1:N").select(
        "kind", "anchor", "n_sources", "n_targets", "confidence")


@query("mappings_for", views=("scripts",), oracle=f"""
WITH {SIG},{ALL_PAIRS},{MAPS},
hit AS (
  SELECT DISTINCT CASE WHEN tname IN (SELECT tname FROM many) THEN 'target' ELSE 'source' END AS anchor_side,
    CASE WHEN tname IN (SELECT tname FROM many) THEN tname ELSE sname END AS anchor, 'source' AS matched_side
  FROM p WHERE contains(lower(sname), '2') AND (tname IN (SELECT tname FROM many) OR sname NOT IN (SELECT sname FROM used))
  UNION SELECT CASE WHEN tname IN (SELECT tname FROM many) THEN 'target' ELSE 'source' END,
    CASE WHEN tname IN (SELECT tname FROM many) THEN tname ELSE sname END, 'target'
  FROM p WHERE contains(lower(tname), '2') AND (tname IN (SELECT tname FROM many) OR sname NOT IN (SELECT sname FROM used)))
SELECT maps.*, matched_side FROM maps JOIN hit USING (anchor, anchor_side)
""")
def mappings_for(spark, folder):
    """Mappings of all workflows with a 2 in the name."""
    m, all_sigs = maps(spark, folder)
    return wm.mappings_for(m, all_sigs, SRC, TGT, "2")


_TRN = lambda x: f"""CASE WHEN contains({x}, 'filter') OR contains({x}, 'where') THEN 'filter' WHEN contains({x}, 'join') THEN 'join'
 WHEN contains({x}, 'group') OR contains({x}, 'agg') THEN 'group' ELSE {x} END"""


@query("logic_similarity", views=("scripts",), oracle=f"""
WITH {SIG}, q AS (SELECT s.name AS sname, t.name AS tname, s.kinds AS sk, t.kinds AS tk, list_distinct(list_concat(s.st, s.tt)) AS sts, list_distinct(list_concat(t.st, t.tt)) AS tts, s.kws AS sw, t.kws AS tw
  FROM sig s JOIN sig t ON s.system = 'hadoop' AND t.system = 'databricks' AND regexp_replace(lower(s.name), '[-_ ]', '', 'g') = regexp_replace(lower(t.name), '[-_ ]', '', 'g')),
r AS (SELECT *, {jac('sk', 'tk')} * 0.4::DOUBLE * CAST(len(sk) + len(tk) > 0 AS INT)
   + CAST(len(list_intersect(sts, tts)) AS DOUBLE) / greatest(len(sts), len(tts), 1) * 0.3::DOUBLE + {jac('sw', 'tw')} * 0.3::DOUBLE AS raw,
  CASE WHEN len(sk) + len(tk) > 0 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len(sts) + len(tts) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN len(sw) + len(tw) > 0 THEN 0.3::DOUBLE ELSE 0 END AS top,
  list_transform(sk, lambda x: {_TRN('x')}) AS na, list_transform(tk, lambda x: {_TRN('x')}) AS nb FROM q)
SELECT sname, tname, round(least(CASE WHEN top > 0 THEN raw / top ELSE 0 END
  + CASE WHEN len(na) > 0 AND len(nb) > 0 THEN CAST(len(list_filter(na, lambda x: list_contains(nb, x))) AS DOUBLE) / greatest(len(na), len(nb)) * 0.2::DOUBLE ELSE 0 END, 1.0), 6) AS logic_score FROM r
""")
def logic_similarity(spark, folder):
    """Logic similarity of the workflows that carry the same name in both systems."""
    all_sigs = cut_lineage(sigs(spark, folder))
    side = lambda system, p: all_sigs.filter(F.col("system") == system).select(
        F.col("name").alias(f"{p}name"), normal_name("name").alias("k"),
        F.col("transformation_types").alias(f"{p}_transformations"),
        F.concat("source_tables", "target_tables").alias(f"{p}_tables"), F.col("business_keywords").alias(f"{p}_rules"))
    pairs = side(SRC, "s").join(side(TGT, "t"), "k")
    return wm.logic_similarity(pairs).select("sname", "tname", "logic_score")


PROFILES = f"""
tabs AS (SELECT process_id, list_sort(list_distinct(list(lower(t)))) AS ts FROM (SELECT process_id, unnest([input_dataset, output_dataset]) AS t FROM components) u GROUP BY process_id),
cnts AS (SELECT process_id, component_type, count(*) AS n FROM components GROUP BY process_id, component_type),
prof AS (SELECT pr.process_id, pr.system, pr.name, coalesce(ts, []) AS ts, {kw('business_function', vocab.FUNCTION_KEYWORDS)} AS dom FROM processes pr LEFT JOIN tabs USING (process_id)),
comp AS (SELECT sid, tid, avg(1 - abs(c1 - c2) / greatest(c1, c2, 1)) AS component_score FROM (
  SELECT k.sid, k.tid, k.component_type, CAST(coalesce(a.n, 0) AS DOUBLE) AS c1, CAST(coalesce(b.n, 0) AS DOUBLE) AS c2 FROM (
    SELECT s.process_id AS sid, t.process_id AS tid, x.component_type FROM prof s JOIN prof t ON s.system = 'hadoop' AND t.system = 'databricks' JOIN cnts x ON x.process_id IN (s.process_id, t.process_id) GROUP BY 1, 2, 3) k
  LEFT JOIN cnts a ON a.process_id = k.sid AND a.component_type = k.component_type LEFT JOIN cnts b ON b.process_id = k.tid AND b.component_type = k.component_type) z GROUP BY sid, tid)"""


def name_sim(a, b):
    la, lb = f"lower({a})", f"lower({b})"
    return f"CASE WHEN {la} = {lb} THEN 1.0::DOUBLE WHEN contains({la}, {lb}) OR contains({lb}, {la}) THEN 0.8::DOUBLE ELSE {jac(f'''list_distinct(string_split({la}, '_'))''', f'''list_distinct(string_split({lb}, '_'))''')} END"


def dom_sim(a, b):
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 0.5::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {jac(a, b)} END"


def best_oracle(threshold: float, profiles: str = PROFILES) -> str:
    return f"""
WITH {profiles}, pr AS (
  SELECT s.process_id AS source_id, t.process_id AS target_id, round(0.2::DOUBLE * ({name_sim('s.name', 't.name')}) + 0.4::DOUBLE * ({jac('s.ts', 't.ts')}) + 0.2::DOUBLE * ({dom_sim('s.dom', 't.dom')}) + 0.2::DOUBLE * coalesce(component_score, 0), 9) AS score
  FROM prof s JOIN prof t ON s.system = 'hadoop' AND t.system = 'databricks' LEFT JOIN comp ON sid = s.process_id AND tid = t.process_id)
SELECT source_id, target_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rn FROM pr WHERE score >= {threshold}) z WHERE rn = 1
"""


@query("match_processes", views=("processes", "components"), oracle=best_oracle(0.7))
def match_processes(spark, folder):
    return mt.match_processes(view(spark, folder, "processes"), view(spark, folder, "components"), SRC, TGT)


@query("match_processes_low", views=("processes", "components"), oracle=best_oracle(0.5))
def match_processes_low(spark, folder):
    """At 0.5 no table needs to be shared."""
    return mt.match_processes(view(spark, folder, "processes"), view(spark, folder, "components"), SRC, TGT, 0.5)


# Processes that list tables of their own and have a description where the function is missing.
OWN_PROCESSES = """
SELECT process_id, system, name, CASE WHEN CAST(substr(process_id, 2) AS BIGINT) % 3 = 0 THEN '' ELSE business_function END AS business_function,
  concat('Matching of ', business_function) AS description, concat('/in/', name, '.csv') AS own_in, concat('/out/', business_domain, '.tbl') AS own_out FROM processes"""


@query("match_processes_own", views=("processes", "components"), oracle=best_oracle(0.45, PROFILES.replace(
    "tabs AS (SELECT process_id, list_sort(list_distinct(list(lower(t)))) AS ts FROM (SELECT process_id, unnest([input_dataset, output_dataset]) AS t FROM components) u GROUP BY process_id)",
    f"own AS ({OWN_PROCESSES}), tabs AS (SELECT process_id, list_sort(list_distinct([lower(name), lower(string_split(string_split(own_out, '/')[-1], '.')[1])])) AS ts FROM own)").replace(
    kw('business_function', vocab.FUNCTION_KEYWORDS), kw("(CASE WHEN business_function <> '' THEN business_function ELSE description END)", vocab.FUNCTION_KEYWORDS)).replace(
    "FROM processes pr LEFT JOIN tabs", "FROM own pr LEFT JOIN tabs")))
def match_processes_own(spark, folder):
    """Own tables instead of those of components, description where the business function is empty."""
    view(spark, folder, "processes").createOrReplaceTempView("processes")
    own = spark.sql(OWN_PROCESSES).withColumn("input_sources", F.array("own_in")).withColumn("output_targets", F.array("own_out"))
    return mt.match_processes(own, view(spark, folder, "components"), SRC, TGT, 0.45)


@query("name_similarity", views=("processes",), oracle=f"""
SELECT s.process_id AS source_id, t.process_id AS target_id, round({name_sim('s.name', 't.name')}, 6) AS name_score
FROM processes s JOIN processes t ON s.system = 'hadoop' AND t.system = 'databricks' AND s.business_domain = t.business_domain
""")
def name_similarity(spark, folder):
    """Names of processes of the same domain."""
    pairs = _domain_pairs(_processes(spark, folder).withColumn("tokens", name_tokens("name")), "name", "tokens")
    return mt.name_pairs(pairs, "s_name", "t_name", "s_tokens", "t_tokens").select("source_id", "target_id", "name_score")


def _processes(spark, folder):
    return view(spark, folder, "processes").withColumnRenamed("process_id", "id")


def _domain_pairs(processes, *columns):
    """All pairs of processes of a domain; what depends on one process alone is worked out before they meet."""
    side = lambda system, name, p: processes.filter(F.col("system") == system).select(
        "business_domain", F.col("id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return join_spread(side(SRC, "source_id", "s"), side(TGT, "target_id", "t"), ["business_domain"])


@query("domain_similarity", views=("processes",), oracle=f"""
SELECT s.process_id AS source_id, t.process_id AS target_id, round({dom_sim(kw('s.business_function', vocab.FUNCTION_KEYWORDS), kw('t.business_function', vocab.FUNCTION_KEYWORDS))}, 6) AS domain_score
FROM processes s JOIN processes t ON s.system = 'hadoop' AND t.system = 'databricks' AND s.business_domain = t.business_domain
""")
def domain_similarity(spark, folder):
    words = contained_words("business_function", vocab.FUNCTION_KEYWORDS)
    pairs = _domain_pairs(_processes(spark, folder).withColumn("words", words), "words")
    return mt.domain_pairs(pairs, "s_words", "t_words").select("source_id", "target_id", "domain_score")


@query("table_overlap", views=("processes", "components"), oracle=f"""
WITH {PROFILES} SELECT s.process_id AS left_key, t.process_id AS right_key, len(list_intersect(s.ts, t.ts)) AS shared, round({jac('s.ts', 't.ts')}, 6) AS table_score
FROM prof s JOIN prof t ON s.system = 'hadoop' AND t.system = 'databricks' WHERE round({jac('s.ts', 't.ts')}, 9) >= 0.25
""")
def table_overlap(spark, folder):
    profiles = cut_lineage(mt.process_profiles(view(spark, folder, "processes"), view(spark, folder, "components")))
    side = lambda system: profiles.filter(F.col("system") == system).select(F.col("process_id").alias("key"), "tables")
    return mt.table_overlaps(side(SRC), side(TGT), 0.25)


@query("count_similarity", views=("processes", "components"), oracle=f"""
WITH {PROFILES} SELECT sid AS source_id, tid AS target_id, round(component_score, 6) AS component_score FROM comp
JOIN processes a ON a.process_id = sid JOIN processes b ON b.process_id = tid WHERE a.business_domain = b.business_domain
  AND sid IN (SELECT process_id FROM cnts) AND tid IN (SELECT process_id FROM cnts)
""")
def count_similarity(spark, folder):
    """Component type counts of processes of the same domain."""
    profiles = mt.process_profiles(view(spark, folder, "processes"), view(spark, folder, "components")) \
        .filter(F.size("type_counts") > 0).select(F.col("process_id").alias("id"), F.map_from_entries("type_counts").alias("m"))
    pairs = _domain_pairs(cut_lineage(_processes(spark, folder).select("id", "system", "business_domain").join(profiles, "id")), "m")
    return mt.count_similarity(pairs, "s_m", "t_m").select("source_id", "target_id", "component_score")


# Matched processes for component-level queries: p<2k> with p<2k+1>.
PROCESS_PAIRS = """
pairs AS (SELECT a.process_id AS source_process, b.process_id AS target_process FROM processes a JOIN processes b
  ON a.system = 'hadoop' AND b.system = 'databricks' AND CAST(substr(b.process_id, 2) AS BIGINT) = CAST(substr(a.process_id, 2) AS BIGINT) + 1)"""


def process_pairs(spark, folder):
    p = view(spark, folder, "processes").select("process_id", "system", F.substring("process_id", 2, 20).cast("bigint").alias("no"))
    a = p.filter(F.col("system") == SRC).select(F.col("process_id").alias("source_process"), (F.col("no") + 1).alias("no"))
    b = p.filter(F.col("system") == TGT).select(F.col("process_id").alias("target_process"), "no")
    return a.join(b, "no").select("source_process", "target_process")


EQUIVALENT = f"""{PROCESS_PAIRS},
tn AS (SELECT process_id, lower(name) AS nm, min(component_id) AS hit FROM component_schemas GROUP BY 1, 2),
sn AS (SELECT DISTINCT source_process, target_process, lower(name) AS nm FROM component_schemas JOIN pairs ON process_id = source_process),
nm_hit AS (SELECT sn.source_process, sn.nm, min(CASE WHEN sn.nm = tn.nm THEN tn.hit END) AS eq, min(tn.hit) AS inc FROM sn JOIN tn ON tn.process_id = sn.target_process AND (contains(sn.nm, tn.nm) OR contains(tn.nm, sn.nm)) GROUP BY 1, 2),
ds AS (SELECT process_id, unnest([input_dataset, output_dataset]) AS d, component_id FROM component_schemas),
dh AS (SELECT process_id, d, min(component_id) AS hit FROM ds GROUP BY 1, 2),
io AS (SELECT s.component_id, min(dh.hit) AS hit FROM ds s JOIN pairs ON s.process_id = source_process JOIN dh ON dh.process_id = target_process AND dh.d = s.d GROUP BY 1),
equivalent AS (SELECT c.component_id AS source_component, coalesce(eq, inc, io.hit) AS target_component, CAST(CASE WHEN eq IS NOT NULL THEN 1 WHEN inc IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS rule
FROM component_schemas c JOIN pairs ON c.process_id = source_process LEFT JOIN nm_hit ON nm_hit.source_process = c.process_id AND nm_hit.nm = lower(c.name) LEFT JOIN io ON io.component_id = c.component_id
WHERE coalesce(eq, inc, io.hit) IS NOT NULL)"""


@query("equivalent_component", views=("processes", "component_schemas"), oracle=f"WITH {EQUIVALENT} SELECT * FROM equivalent")
def equivalent_component(spark, folder):
    comps = view(spark, folder, "component_schemas").select(
        "component_id", "process_id", "name", F.array("input_dataset", "output_dataset").alias("datasets"))
    return mt.equivalent_component(process_pairs(spark, folder), comps, comps)


@query("name_matches", views=("scripts",), oracle="""
SELECT a.name AS source_name, b.name AS target_name FROM scripts a JOIN scripts b ON a.system = 'hadoop' AND b.system = 'databricks'
 AND regexp_replace(lower(a.name), '[-_ ]', '', 'g') = regexp_replace(lower(b.name), '[-_ ]', '', 'g')
""")
def name_matches(spark, folder):
    scripts = view(spark, folder, "scripts")
    return mt.name_matches(scripts.filter(F.col("system") == SRC), scripts.filter(F.col("system") == TGT))


_HITS = "SELECT script_id, concat(CASE script_id % 3 WHEN 0 THEN 'repo1' WHEN 1 THEN 's1' ELSE 'x_2' END) AS entity, path, script_id % 13 + 1 AS rank FROM scripts"


@query("name_search", views=("scripts",), oracle=f"""
WITH h AS ({_HITS}), f AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS fn FROM h)
SELECT script_id, score FROM (SELECT script_id, CASE WHEN contains(lower(path), entity) THEN 0.7::DOUBLE WHEN contains(fn, entity) THEN 0.6::DOUBLE
  WHEN len(list_filter(string_split(entity, '_'), lambda w: contains(fn, w))) > 0 THEN 0.5::DOUBLE WHEN rank <= 5 THEN 0.4::DOUBLE END AS score FROM f) z WHERE score IS NOT NULL
""")
def name_search(spark, folder):
    view(spark, folder, "scripts").createOrReplaceTempView("scripts")
    return mt.name_search(spark.sql(_HITS)).select("script_id", "score")


@query("inherit_group", views=("processes", "components"), oracle="""
SELECT component_id, process_id, split_part(path, '/', 3) AS project FROM components JOIN processes USING (process_id)
""")
def inherit_group(spark, folder):
    groups = view(spark, folder, "processes").select("process_id", F.split("path", "/").getItem(2).alias("project"))
    return mt.inherit_group(view(spark, folder, "components").select("component_id", "process_id"), groups)


@query("flow_level", views=("processes", "components"), oracle=f"""
WITH {PROFILES}, m AS (SELECT s.process_id AS entity, t.system AS target_system, t.process_id AS te, round({jac('s.ts', 't.ts')}, 9) AS score,
  CAST(substr(t.process_id, 2) AS BIGINT) AS o FROM prof s JOIN prof t ON s.system = 'hadoop' AND t.system = 'databricks' WHERE round({jac('s.ts', 't.ts')}, 9) >= 0.25)
SELECT entity, target_system, te AS target_entity, round(score, 6) AS score, n AS match_count, 'equivalent_implementation' AS relationship_type
FROM (SELECT *, row_number() OVER (PARTITION BY entity, target_system ORDER BY score DESC, o DESC) AS rn, count(*) OVER (PARTITION BY entity, target_system) AS n FROM m) z WHERE rn = 1
""")
def flow_level(spark, folder):
    """Best process of the other system by shared tables."""
    profiles = cut_lineage(mt.process_profiles(view(spark, folder, "processes"), view(spark, folder, "components")))
    side = lambda system: profiles.filter(F.col("system") == system).select(F.col("process_id").alias("key"), "tables")
    return mt.best_overlaps(side(SRC), side(TGT), 0.25).select(
        F.col("left_key").alias("entity"), F.lit(TGT).alias("target_system"), F.col("right_key").alias("target_entity"),
        F.col("table_score").alias("score"), F.col("matches").alias("match_count"), F.lit("equivalent_implementation").alias("relationship_type"))


@query("clean_names", oracle="""
SELECT c_custkey, regexp_replace(lower(c_name), '[-_ ]', '', 'g') AS normal, lower(string_split(string_split(concat('/data/In/', c_name, '.', c_mktsegment), '/')[-1], '.')[1]) AS table_name,
  left(md5(concat('gap_', CAST(c_custkey AS VARCHAR))), 16) AS gap_id, left(md5(concat(c_name, '_', c_mktsegment)), 8) AS short FROM customer
""")
def clean_names(spark, folder):
    c = spark.read.parquet(f"{folder}/customer.parquet")
    return c.select(
        "c_custkey", normal_name("c_name").alias("normal"),
        clean_table(F.concat(F.lit("/data/In/"), "c_name", F.lit("."), "c_mktsegment")).alias("table_name"),
        short_id(F.lit("gap"), F.col("c_custkey").cast("string")).alias("gap_id"),
        short_id("c_name", "c_mktsegment", size=8).alias("short"))


@query("set_operations", views=("scripts",), oracle=f"""
WITH {SIG} SELECT s.name AS sname, t.name AS tname, array_to_string(list_sort(list_intersect(s.st, t.st)), '|') AS shared,
  array_to_string(list_sort(list_filter(s.tt, lambda x: NOT list_contains(t.tt, x))), '|') AS missing, array_to_string(list_sort(list_distinct(list_concat(s.tt, t.tt))), '|') AS all_targets
FROM sig s JOIN sig t ON s.system = 'hadoop' AND t.system = 'databricks' AND regexp_replace(lower(s.name), '[-_ ]', '', 'g') = regexp_replace(lower(t.name), '[-_ ]', '', 'g')
""")
def set_operations(spark, folder):
    """Table sets of same-name workflows: intersection, difference and union."""
    all_sigs = cut_lineage(sigs(spark, folder))
    side = lambda system, p: all_sigs.filter(F.col("system") == system).select(
        F.col("name").alias(f"{p}name"), normal_name("name").alias("k"), F.col("source_tables").alias(f"{p}_src"), F.col("target_tables").alias(f"{p}_tgt"))
    return side(SRC, "s").join(side(TGT, "t"), "k").select(
        "sname", "tname", F.array_sort(F.array_intersect("s_src", "t_src")).alias("shared"),
        F.array_sort(F.array_except("s_tgt", "t_tgt")).alias("missing"),
        F.array_sort(F.array_union("s_tgt", "t_tgt")).alias("all_targets"))
