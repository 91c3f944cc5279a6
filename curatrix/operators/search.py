"""Search over catalog items: per-field match quality, best field per item, configurable ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.skew import first_per_key


@dataclass(frozen=True)
class FieldConfig:
    """``match`` is exact, prefix, substring or fuzzy; a lower priority is more important."""

    name: str
    match: str
    priority: int
    boost: float = 1.0
    indexed: bool = True


def _fuzzy(v: Column, q: str) -> Column:
    letters = sorted(set(q))
    shared = sum((F.when(v.contains(c), 1).otherwise(0) for c in letters), F.lit(0))
    subsequence = v.rlike("(?s)" + ".*".join(re.escape(c) for c in q))
    return F.when(v.contains(q), 0.9).when(subsequence, 0.7).when(shared / F.lit(float(len(letters))) >= 0.8, 0.5).otherwise(0.0)


def search_quality(value: Column, query: str, match: str) -> Column:
    """How well a text matches: 1 at the start or in full, less further in, 0 for no match, empty or NULL."""
    q = query.lower()
    v = F.lower(value)
    if match == "exact":
        score = F.when(v == q, 1.0).otherwise(0.0)
    elif match == "prefix":
        later_word = v.rlike(r"[\s/]" + re.escape(q))
        score = F.when(v.startswith(q), 1.0).when(later_word, 0.9).otherwise(0.0)
    elif match == "substring":
        score = F.when(v.startswith(q), 1.0).when(v.contains(" " + q), 0.9).when(v.contains(q), 0.8).otherwise(0.0)
    elif match == "fuzzy":
        score = _fuzzy(v, q)
    else:
        raise ValueError(match)
    return F.when(F.length(value) > 0, score).otherwise(0.0)


def field_matches(items: DataFrame, query: str, configs: list[FieldConfig]) -> DataFrame:
    """One row per item and matching field; the items keep ``id``, ``type`` and ``title``."""
    packs = [
        F.struct(F.lit(c.name).alias("field"), F.lit(c.priority).alias("priority"), F.lit(float(c.boost)).alias("boost"),
                 search_quality(F.col(c.name), query, c.match).alias("quality"))
        for c in configs if c.indexed
    ]
    rows = items.select("id", "type", "title", F.explode(F.array(*packs)).alias("m")).select("id", "type", "title", "m.*")
    return rows.filter(F.col("quality") > 0).withColumn("score", F.col("boost") * F.col("quality"))


def best_field(items: DataFrame, query: str, configs: list[FieldConfig]) -> DataFrame:
    """The most important matching field of each item, decided inside the row: no shuffle.

    Candidates are compared as (priority, -score, position of the field).
    """
    packs = []
    for pos, c in enumerate(c for c in configs if c.indexed):
        quality = search_quality(F.col(c.name), query, c.match)
        packs.append(F.when(quality > 0, F.struct(
            F.lit(c.priority).alias("priority"), (-quality * c.boost).alias("neg"), F.lit(pos).alias("pos"),
            F.lit(c.name).alias("field"), quality.alias("quality"))))
    best = F.array_min(F.filter(F.array(*packs), lambda m: m.isNotNull()))
    out = items.select("id", "type", "title", best.alias("b")).filter("b IS NOT NULL")
    return out.select("id", "type", "title", "b.field", "b.priority", "b.quality", (-F.col("b.neg")).alias("score"))


# Ranking keys.
RANKING_KEYS = {
    "match_priority": lambda: F.col("priority").asc(),
    "boost_score": lambda: F.col("score").desc(),
    "title_asc": lambda: F.lower(F.coalesce("title", F.lit(""))).asc(),
    "title_desc": lambda: F.lower(F.coalesce("title", F.lit(""))).desc(),
}


def rank_matches(matches: DataFrame, ranking: tuple[str, ...], limit: int | None = None) -> DataFrame:
    out = matches.orderBy(*[RANKING_KEYS[k]() for k in ranking], "id")
    return out if limit is None else out.limit(limit)


def concept_search(concepts: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Score label, comment and IRI hits; best first, ties by IRI."""
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    label, comment, iri = has("label"), has("comment"), has("iri")
    exact = F.coalesce(F.lower("label") == q, F.lit(False))
    score = F.when(label, 10.0).otherwise(0.0) + F.when(exact, 20.0).otherwise(0.0) + F.when(comment, 5.0).otherwise(0.0) + F.when(iri, 3.0).otherwise(0.0)
    kind = F.when(label, "label").when(comment, "comment").when(iri, "iri")
    hits = concepts.select("iri", "label", score.alias("score"), kind.alias("match_type")).filter(F.col("score") > 0)
    hits = hits.orderBy(F.col("score").desc(), "iri")
    return hits if limit is None else hits.limit(limit)


# Scope levels from the widest to the narrowest.
SCOPE_ORDER = ("enterprise", "domain", "department", "team", "project", "external")


def scope_rank(scope: Column) -> Column:
    pos = F.array_position(F.array(*map(F.lit, SCOPE_ORDER)), scope)
    return F.when(F.coalesce(pos, F.lit(0)) > 0, pos - 1).otherwise(99)


def collection_order(collections: DataFrame) -> DataFrame:
    return collections.withColumn("scope_rank", scope_rank(F.col("scope_level"))).orderBy("scope_rank", "label", "iri")


def top_matches_per_type(matches: DataFrame, k: int) -> DataFrame:
    """The first ``k`` matches of every item type."""
    return first_per_key(matches, ["type"], [F.col("priority"), F.col("score").desc(), F.col("id")], k, "rank")
