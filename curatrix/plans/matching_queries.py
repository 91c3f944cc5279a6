"""Registered queries: record matching and merging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from curatrix.functions.similarity import similarity
from curatrix.operators import linking as lk
from curatrix.operators import matching as mt
from curatrix.operators.matching import MatchRule
from curatrix.plans.registry import query

RULES = [
    MatchRule("email", "exact", ("email",), 0.5, 0.75),
    MatchRule("phone", "deterministic", ("phone", "unknown_field"), 0.3, 0.8),
    MatchRule("name", "fuzzy", ("customer_name",), 0.4, 0.9),
    MatchRule("ghost", "deterministic", ("nothing",), 5.0, 0.95),
]
FIELDS = ["customer_name", "email", "phone"]

_P7 = "right(regexp_replace({c}, '[^0-9]', '', 'g'), 7)"
_PROF = "SELECT customer_name, email, phone, MIN(id) AS first_id, COUNT(*) AS records FROM {t} GROUP BY 1, 2, 3"
_PM, _PS = _PROF.replace("{t}", "{mdm_master}"), _PROF.replace("{t}", "{mdm_source}")
_EM, _PH = "(lower(trim(m.email)) = lower(trim(s.email)))", f"({_P7.format(c='m.phone')} = {_P7.format(c='s.phone')})"
_NAME = """(CASE WHEN length(m.customer_name) > 0 AND length(s.customer_name) > 0 THEN 1 - levenshtein(lower(m.customer_name), lower(s.customer_name))::DOUBLE / greatest(length(m.customer_name), length(s.customer_name)) ELSE 0 END)"""
_CONF = f"((CASE WHEN {_EM} THEN 0.5 ELSE 0 END)::DOUBLE + (CASE WHEN {_PH} THEN 0.3 ELSE 0 END)::DOUBLE + {_NAME} * 0.4::DOUBLE) / 1.2::DOUBLE"
_PAIRS = f"""SELECT * FROM (SELECT m.first_id AS master_id, s.first_id AS source_id, m.records AS master_records, s.records AS source_records, {_CONF} AS conf,
 concat_ws(',', CASE WHEN {_EM} THEN 'email' END, CASE WHEN {_PH} THEN 'phone' END, CASE WHEN {_NAME} > 0 THEN 'name' END) AS matched_rules,
 m.customer_name AS m_name, m.email AS m_email, m.phone AS m_phone, s.customer_name AS s_name, s.email AS s_email, s.phone AS s_phone FROM ({_PM}) m, ({_PS}) s) WHERE conf >= 0.75 - 1e-9"""


def _profiles(d):
    m, mm = mt.profiles(d["mdm_master"], FIELDS, "id")
    s, sm = mt.profiles(d["mdm_source"], FIELDS, "id")
    return m, mm, s, sm


def _matches(d):
    m, mm, s, sm = _profiles(d)
    return mt.find_matches(m, s, RULES), mm, sm


@query("match_profiles", "J7 ER1 ER2 ER3 ER4 ER5 ER6 SC5 SC6 UD2", f"SELECT master_id, source_id, master_records, source_records, ROUND(conf, 6) AS confidence, matched_rules FROM ({_PAIRS})")
def match_profiles(d):
    """Every pair above the threshold, as the full comparison would find it (the oracle compares all pairs)."""
    out, _, _ = _matches(d)
    return out.select(
        F.col("m_first_id").alias("master_id"), F.col("s_first_id").alias("source_id"), F.col("m_records").alias("master_records"), F.col("s_records").alias("source_records"),
        F.round("confidence", 6).alias("confidence"), F.array_join("matched_rules", ",").alias("matched_rules"))


@query("match_mapped_columns", "ER1 ER2", f"SELECT master_id, source_id, ROUND(conf, 6) AS confidence, matched_rules FROM ({_PAIRS})")
def match_mapped_columns(d):
    """The same matches from a source whose columns have names of their own."""
    foreign = d["mdm_source"].select("id", F.col("customer_name").alias("Full_Name"), F.col("email").alias("mail"), "phone")
    source = mt.with_master_columns(foreign, {"full_name": "customer_name", "MAIL": "email"}, ["id", *FIELDS])
    m, _ = mt.profiles(d["mdm_master"], FIELDS, "id")
    s, _ = mt.profiles(source, FIELDS, "id")
    out = mt.find_matches(m, s, RULES)
    return out.select(F.col("m_first_id").alias("master_id"), F.col("s_first_id").alias("source_id"), F.round("confidence", 6).alias("confidence"), F.array_join("matched_rules", ",").alias("matched_rules"))


_TEXT = "1 - levenshtein(lower(m.p_name), lower(s.p_name))::DOUBLE / greatest(length(m.p_name), length(s.p_name))"


@query("match_text_only", "ER1 ER3", f"""
SELECT m.p_name AS m_name, s.p_name AS s_name, ROUND({_TEXT}, 6) AS confidence FROM (SELECT DISTINCT p_name FROM part) m,
 (SELECT DISTINCT replace(p_name, 'e', 'a') AS p_name FROM part) s WHERE {_TEXT} >= 0.75 - 1e-9""")
def match_text_only(d):
    """A rule set of one text rule: every pair that the comparison of all with all finds."""
    names = d["part"].select(F.col("p_partkey").alias("id"), "p_name")
    m, _ = mt.profiles(names, ["p_name"], "id")
    s, _ = mt.profiles(names.withColumn("p_name", F.replace("p_name", F.lit("e"), F.lit("a"))), ["p_name"], "id")
    out = mt.find_matches(m, s, [MatchRule("name", "fuzzy", ("p_name",), 1.0, 0.75)])
    return out.select(F.col("m_p_name").alias("m_name"), F.col("s_p_name").alias("s_name"), F.round("confidence", 6).alias("confidence"))


def _places(c):
    """DuckDB: for each character of ``c`` the places where it stands, as bits."""
    return f"""map_from_entries(list_transform(list_distinct(string_split(lower({c}), '')), lambda ch: struct_pack(k := ch, v := list_sum(list_transform(range(1, length({c}) + 1),
 lambda i: CASE WHEN substr(lower({c}), i, 1) = ch THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT)))"""


def _common(places, size, text):
    """DuckDB: length of the longest common subsequence of ``text`` (at most 100 characters) and the text behind ``places``."""
    full = f"((1::HUGEINT << {size}::INT) - 1)"
    return f"""({size} - bit_count(list_reduce([{full}] || list_transform(string_split(lower({text}), ''), lambda ch: COALESCE({places}[ch], 0::HUGEINT)),
 lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})))"""


@query("match_indel", "J7 ER1 ER3 SC8", f"""
SELECT m_name, s_name, ROUND(r, 6) AS confidence FROM (SELECT m.p_name AS m_name, s.p_name AS s_name, 2.0::DOUBLE * {_common('m.places', 'm.size', 's.p_name')} / (m.size + length(s.p_name)) AS r
 FROM (SELECT p_name, length(p_name) AS size, {_places('p_name')} AS places FROM (SELECT DISTINCT p_name FROM part)) m, (SELECT DISTINCT replace(p_name, 'e', 'a') AS p_name FROM part) s) WHERE r >= 0.8 - 1e-9""")
def match_indel(d):
    """One text rule by the longest common subsequence: every pair that the comparison of all with all finds."""
    names = d["part"].select(F.col("p_partkey").alias("id"), "p_name")
    m, _ = mt.profiles(names, ["p_name"], "id")
    s, _ = mt.profiles(names.withColumn("p_name", F.replace("p_name", F.lit("e"), F.lit("a"))), ["p_name"], "id")
    out = mt.find_matches(m, s, [MatchRule("name", "fuzzy", ("p_name",), 1.0, 0.8, "indel")])
    return out.select(F.col("m_p_name").alias("m_name"), F.col("s_p_name").alias("s_name"), F.round("confidence", 6).alias("confidence"))


_WINDOWS = f"""(SELECT MAX({_common('t.places', 't.size', 'substr(t.b, i, t.size)')}) FROM range(1, length(t.b) - t.size + 2) w(i))"""


@query("text_ratios", "SC8 ER3", f"""
SELECT p_partkey, ROUND(2.0::DOUBLE * {_common('t.places', 't.size', 't.b')} / (t.size + length(t.b)), 6) AS indel, ROUND({_WINDOWS}::DOUBLE / t.size, 6) AS partial
FROM (SELECT p_partkey, p_name AS a, p_type || ' ' || p_brand || ' ' || p_name[3:] || ' ' || p_name[:4] AS b, length(p_name) AS size, {_places('p_name')} AS places FROM part) t""")
def text_ratios(d):
    """Indel ratio and its best window, of a name and a longer text around parts of it."""
    longer = F.concat_ws(" ", "p_type", "p_brand", F.expr("substr(p_name, 3)"), F.expr("substr(p_name, 1, 4)"))
    part = d["part"].withColumn("longer", longer)
    ratio = lambda how: F.round(similarity(F.col("p_name"), F.col("longer"), how), 6)
    return part.select("p_partkey", ratio("indel").alias("indel"), ratio("partial").alias("partial"))


_JSON = "to_json({{'id': {a}.id, 'customer_name': {a}.customer_name, 'email': {a}.email, 'phone': {a}.phone, 'segment': {a}.segment}})::VARCHAR"


@query("pair_candidates", "ER7", f"""
SELECT s.id AS source_id, m.id AS master_id, ROUND(p.conf, 6) AS confidence, {_JSON.format(a='m')} AS master_record, {_JSON.format(a='s')} AS source_record FROM ({_PAIRS}) p
 JOIN {{mdm_master}} m ON m.customer_name = p.m_name AND m.email IS NOT DISTINCT FROM p.m_email AND m.phone = p.m_phone
 JOIN {{mdm_source}} s ON s.customer_name = p.s_name AND s.email IS NOT DISTINCT FROM p.s_email AND s.phone = p.s_phone""")
def pair_candidates(d):
    out, mm, sm = _matches(d)
    cols = ["id", *FIELDS, "segment"]
    found = mt.pair_candidates(out, d["mdm_master"].select(*cols), d["mdm_source"].select(*cols), mm, sm, "id")
    return found.select("source_id", "master_id", F.round("confidence", 6).alias("confidence"), "master_record", "source_record")


_BEST = f"""SELECT s.id AS source_id, b.master_id, COALESCE(b.conf, 1.0) AS conf, COALESCE(b.matched_rules, '') AS matched_rules FROM {{mdm_source}} s
 LEFT JOIN (SELECT * FROM ({_PAIRS}) QUALIFY ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY conf DESC, master_id) = 1) b ON b.s_name = s.customer_name AND b.s_email IS NOT DISTINCT FROM s.email AND b.s_phone = s.phone"""
_CANDS = f"""SELECT source_id, master_id, ROUND(conf, 6) AS confidence, CASE WHEN master_id IS NULL THEN 'new' WHEN conf >= 0.95 THEN 'exact' WHEN conf >= 0.85 THEN 'fuzzy' ELSE 'probabilistic' END AS match_type, matched_rules FROM ({_BEST})"""


def _candidates(d):
    out, _, sm = _matches(d)
    return mt.best_candidates(out, sm)


@query("match_candidates", "ER7 SC9 J8", _CANDS)
def match_candidates(d):
    return _candidates(d).select("source_id", "master_id", F.round("confidence", 6).alias("confidence"), "match_type", F.array_join("matched_rules", ",").alias("matched_rules"))


@query("match_run_totals", "ER8", f"""
SELECT COUNT(*) FILTER (match_type <> 'new') AS matches, COUNT(*) FILTER (match_type = 'new') AS new_records, (SELECT COUNT(*) FROM {{mdm_source}}) AS source_count, (SELECT COUNT(*) FROM {{mdm_master}}) AS master_count FROM ({_CANDS})""")
def match_run_totals(d):
    return mt.run_totals(_candidates(d), d["mdm_master"], d["mdm_source"])


@query("block_pairs", "ER1 J7", f"""
SELECT m.first_id AS master_id, s.first_id AS source_id FROM ({_PM}) m JOIN ({_PS}) s ON {_EM} OR {_PH}""")
def block_pairs(d):
    m, _, s, _ = _profiles(d)
    blocks = [(("email", mt.normalized("email", F.col("email"))),), (("phone", mt.normalized("phone", F.col("phone"))),)]
    return mt.block_pairs(m, s, blocks).select(F.col("m_first_id").alias("master_id"), F.col("s_first_id").alias("source_id"))


@query("new_source_records", "J8", "SELECT id FROM {mdm_source} s WHERE NOT EXISTS (SELECT 1 FROM {mdm_master} m WHERE lower(trim(m.email)) = lower(trim(s.email)))")
def new_source_records(d):
    key = mt.normalized("email", F.col("email"))
    src = d["mdm_source"].withColumn("match_key", key)
    return lk.new_records(src, d["mdm_master"].select(key.alias("match_key")), "match_key").select("id")


_STRATEGY = {"customer_name": "most_complete", "email": "master_wins", "phone": "most_recent"}
_MF = ["customer_name", "email", "phone", "segment"]


def _pick(f):
    m, s = f"m_{f}", f"s_{f}"
    has = lambda c: f"COALESCE({c}, '') <> ''"
    rule = {"customer_name": f"CASE WHEN {has(s)} AND (NOT {has(m)} OR length({s}) > length({m})) THEN {s} ELSE {m} END", "email": f"CASE WHEN {has(m)} THEN {m} ELSE {s} END"}
    return f"CASE WHEN master_id IS NULL THEN {s} ELSE {rule.get(f, f'CASE WHEN {has(s)} THEN {s} ELSE {m} END')} END"


@query("survivorship", "ER9", "SELECT source_id, " + ", ".join(f"{_pick(f)} AS merged_{f}" for f in _MF) + " FROM {merge_candidates}")
def survivorship(d):
    out = mt.survivorship(d["merge_candidates"], _MF, _STRATEGY, F.col("master_id").isNotNull())
    return out.select("source_id", *[f"merged_{f}" for f in _MF])


@query("most_trusted", "ER10", "SELECT k, arg_min(value, (priority, value)) AS value FROM {mdm_values} WHERE value <> '' GROUP BY k")
def most_trusted(d):
    return mt.most_trusted(d["mdm_values"], "k", "value", "priority")


_MERGED = "SELECT source_id, master_id, confidence, " + ", ".join(
    f"{_pick(f)} AS merged_{f}" if f != "segment" else f"COALESCE(given_segment, {_pick(f)}) AS merged_segment" for f in _MF) + " FROM {merge_candidates} WHERE status = 'approved'"


@query("merge_approved", "ER11", f"SELECT source_id, 'merged' AS status, merged_customer_name, merged_email, merged_phone, merged_segment FROM ({_MERGED})")
def merge_approved(d):
    return mt.merge_approved(d["merge_candidates"], _MF, _STRATEGY).select("source_id", "status", *[f"merged_{f}" for f in _MF])


@query("golden_table", "ER11", f"""
SELECT m.id, CASE WHEN u.master_id IS NULL THEN m.customer_name ELSE u.merged_customer_name END AS customer_name, CASE WHEN u.master_id IS NULL THEN m.email ELSE u.merged_email END AS email,
 CASE WHEN u.master_id IS NULL THEN m.phone ELSE u.merged_phone END AS phone, CASE WHEN u.master_id IS NULL THEN m.segment ELSE u.merged_segment END AS segment
FROM {{mdm_master}} m LEFT JOIN ({_MERGED}) u ON u.master_id = m.id""")
def golden_table(d):
    return mt.golden_table(d["mdm_master"], mt.merge_approved(d["merge_candidates"], _MF, _STRATEGY), "id", _MF)


@query("route_candidates", "ER12", f"""
SELECT CASE WHEN confidence >= 0.95 THEN 'auto_merge' WHEN confidence >= 0.90 THEN 'review' WHEN confidence >= 0.80 THEN 'valid' ELSE 'reject' END AS route, COUNT(*) AS n FROM ({_CANDS}) GROUP BY 1""")
def route_candidates(d):
    return _candidates(d).groupBy(mt.route(F.col("confidence")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("exclude_records", "ER12", "SELECT id FROM {mdm_source} WHERE NOT (COALESCE(email LIKE '%@y.org', false) OR customer_name = 'Shared Desk')")
def exclude_records(d):
    return mt.exclude(d["mdm_source"], [F.col("email").endswith("@y.org"), F.col("customer_name") == "Shared Desk"]).select("id")


@query("changed_since", "ER12", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def changed_since(d):
    return mt.changed_since(d["orders"], "o_orderdate", datetime(2000, 6, 1)).select("o_orderkey")


@query("sync_review_status", "ER13", """
SELECT review_id, status AS new_status FROM {merge_candidates} WHERE status IN ('approved', 'rejected') AND review_id IN (SELECT id FROM {mdm_source} WHERE segment IS NOT NULL)""")
def sync_review_status(d):
    return mt.sync_review_status(d["merge_candidates"], d["mdm_source"].filter("segment IS NOT NULL").select(F.col("id").alias("review_id")))


@query("sync_review_counts", "ER13", """
SELECT COUNT(*) FILTER (ok AND status = 'approved') AS synced_approved, COUNT(*) FILTER (ok AND status = 'rejected') AS synced_rejected, COUNT(*) FILTER (NOT (ok AND status IN ('approved', 'rejected'))) AS skipped
FROM (SELECT status, COALESCE(review_id IN (SELECT id FROM {mdm_source} WHERE segment IS NOT NULL), false) AS ok FROM {merge_candidates})""")
def sync_review_counts(d):
    return mt.sync_counts(d["merge_candidates"], d["mdm_source"].filter("segment IS NOT NULL").select(F.col("id").alias("review_id")))
