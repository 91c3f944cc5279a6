"""Registered queries: catalog search."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import search as se
from curatrix.operators.search import FieldConfig
from curatrix.plans.registry import query

_CONFIGS = [FieldConfig("title", "prefix", 1, 2.0), FieldConfig("tags", "substring", 2, 1.5), FieldConfig("description", "fuzzy", 2, 1.0), FieldConfig("type", "exact", 3, 1.0), FieldConfig("id", "exact", 0, 9.0, indexed=False)]


def _quality(col, q, match):
    v = f"lower({col})"
    if match == "exact":
        s = f"CASE WHEN {v} = '{q}' THEN 1.0 ELSE 0.0 END"
    elif match == "prefix":
        s = f"CASE WHEN starts_with({v}, '{q}') THEN 1.0 WHEN regexp_matches({v}, '[\\s/]{q}') THEN 0.9 ELSE 0.0 END"
    elif match == "substring":
        s = f"CASE WHEN starts_with({v}, '{q}') THEN 1.0 WHEN contains({v}, ' {q}') THEN 0.9 WHEN contains({v}, '{q}') THEN 0.8 ELSE 0.0 END"
    else:
        letters = sorted(set(q))
        shared = " + ".join(f"CASE WHEN contains({v}, '{c}') THEN 1 ELSE 0 END" for c in letters)
        s = f"CASE WHEN contains({v}, '{q}') THEN 0.9 WHEN {v} LIKE '%{'%'.join(q)}%' THEN 0.7 WHEN ({shared})::DOUBLE / {len(letters)} >= 0.8 THEN 0.5 ELSE 0.0 END"
    return f"CASE WHEN length({col}) > 0 THEN {s} ELSE 0.0 END::DOUBLE"


def _matches(q):
    return " UNION ALL ".join(
        f"SELECT id, type, title, '{c.name}' AS field, {c.priority} AS priority, {c.boost}::DOUBLE AS boost, {_quality(c.name, q, c.match)} AS quality, {i} AS pos FROM {{search_items}}"
        for i, c in enumerate(c for c in _CONFIGS if c.indexed))


_BEST = "SELECT id, type, title, field, priority, quality, boost * quality AS score FROM ({m}) WHERE quality > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY priority, boost * quality DESC, pos) = 1"


@query("search_quality", "SC10", f"SELECT id, field, priority, quality, boost * quality AS score FROM ({_matches('widge')}) WHERE quality > 0")
def search_quality(d):
    return se.field_matches(d["search_items"], "widge", _CONFIGS).select("id", "field", "priority", "quality", "score")


@query("best_field", "S2", _BEST.format(m=_matches("ring")).replace("{search_items}", "{search_items}"))
def best_field(d):
    return se.best_field(d["search_items"], "RING", _CONFIGS)


@query("rank_matches", "S1", f"""
SELECT id, title, priority, score, CAST(ROW_NUMBER() OVER (ORDER BY priority, score DESC, lower(title), id) AS INT) AS position FROM ({_BEST.format(m=_matches('small'))}) ORDER BY priority, score DESC, lower(title), id LIMIT 40""")
def rank_matches(d):
    from pyspark.sql import Window as W

    top = se.rank_matches(se.best_field(d["search_items"], "small", _CONFIGS), ("match_priority", "boost_score", "title_asc"), 40)
    w = W.orderBy("priority", F.col("score").desc(), F.lower("title"), "id")
    return top.select("id", "title", "priority", "score", F.row_number().over(w).alias("position"))


@query("top_matches_per_type", "S1 W8", f"""
SELECT type, id, rank FROM (SELECT type, id, CAST(ROW_NUMBER() OVER (PARTITION BY type ORDER BY priority, score DESC, id) AS INT) AS rank FROM ({_BEST.format(m=_matches('bolt'))})) WHERE rank <= 5""")
def top_matches_per_type(d):
    return se.top_matches_per_type(se.best_field(d["search_items"], "bolt", _CONFIGS), 5).select("type", "id", "rank")


_CONCEPTS = """SELECT 'http://x.org/' || LOWER(p_type) || '/' || CAST(p_partkey AS STRING) AS iri, CASE WHEN p_size % 6 = 0 THEN p_type ELSE p_name || ' ' || p_type END AS label,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'A ' || p_brand || ' ' || p_type || ' thing' END AS comment FROM {part}"""


@query("concept_search", "S3", f"""
SELECT iri, label, score, match_type FROM (SELECT iri, label, CASE WHEN contains(lower(label), 'small') THEN 10.0 ELSE 0 END + CASE WHEN lower(label) = 'small' THEN 20.0 ELSE 0 END
  + CASE WHEN contains(lower(comment), 'small') THEN 5.0 ELSE 0 END + CASE WHEN contains(lower(iri), 'small') THEN 3.0 ELSE 0.0::DOUBLE END AS score,
  CASE WHEN contains(lower(label), 'small') THEN 'label' WHEN contains(lower(comment), 'small') THEN 'comment' ELSE 'iri' END AS match_type FROM ({_CONCEPTS}))
WHERE score > 0 ORDER BY score DESC, iri LIMIT 50""")
def concept_search(d):
    return se.concept_search(d.sql(_CONCEPTS), "Small", 50)


_COLL = """SELECT c_custkey AS iri, c_name AS label, CASE c_nationkey % 8 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'domain' WHEN 2 THEN 'department' WHEN 3 THEN 'team' WHEN 4 THEN 'project' WHEN 5 THEN 'external'
 WHEN 6 THEN 'galaxy' ELSE NULL END AS scope_level FROM {customer}"""


@query("collection_order", "S4", f"""
SELECT iri, label, scope_level, CASE scope_level WHEN 'enterprise' THEN 0 WHEN 'domain' THEN 1 WHEN 'department' THEN 2 WHEN 'team' THEN 3 WHEN 'project' THEN 4 WHEN 'external' THEN 5 ELSE 99::BIGINT END AS scope_rank FROM ({_COLL})""")
def collection_order(d):
    return se.collection_order(d.sql(_COLL))
