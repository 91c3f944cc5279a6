"""Compliance policies: structured rules evaluated over all governed entities at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.quality import score_expr
from curatrix.operators.skew import first_per_key

# Entity types that the match type "Object" stands for.
OBJECT_TYPES = (
    "catalog", "schema", "table", "view", "function", "volume", "data_product", "data_contract", "domain", "glossary_term",
)


@dataclass(frozen=True)
class Action:
    """PASS, FAIL (value = message), ASSIGN_TAG (key, value), REMOVE_TAG (key) or NOTIFY (value = recipients)."""

    kind: str
    key: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Rule:
    """``where`` and ``assertion`` are two-valued Columns over the entity frame."""

    match_type: str
    assertion: Column = field(compare=False)
    where: Column | None = field(default=None, compare=False)
    on_pass: tuple[Action, ...] = ()
    on_fail: tuple[Action, ...] = ()


def match_entities(entities: DataFrame, match_type: str, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Entities of one type (``Object`` = every type) that satisfy the WHERE clause; a NULL outcome drops the entity."""
    types = list(OBJECT_TYPES) if match_type.lower() == "object" else [match_type.lower()]
    out = entities.filter(F.col("type").isin(types))
    out = out if where is None else out.filter(F.coalesce(where, F.lit(False)))
    return out if limit is None else out.orderBy("id").limit(limit)


def select_policies(
    policies: DataFrame, which: str = "active", ids=None, categories=None, severities=None
) -> DataFrame:
    """All, active or listed policies, narrowed by category and severity; severity descending (as text), then name."""
    out = policies
    if ids is not None:
        out = out.filter(F.col("id").isin(list(ids)))
    elif which == "active":
        out = out.filter("is_active")
    if categories:
        out = out.filter(F.col("category").isin(list(categories)))
    if severities:
        out = out.filter(F.col("severity").isin(list(severities)))
    return out.orderBy(F.col("severity").desc(), "name", "id")


def evaluate_policy(entities: DataFrame, rule: Rule, policy_id: str, limit: int | None = None) -> DataFrame:
    """One result row per matched entity; a FAIL action's text replaces the message."""
    texts = [a.value for a in rule.on_fail if a.kind == "FAIL" and a.value]
    passed = F.coalesce(rule.assertion, F.lit(False))
    return match_entities(entities, rule.match_type, rule.where, limit).select(
        F.lit(policy_id).alias("policy_id"), F.col("id").alias("object_id"), "type", "name", passed.alias("passed")
    ).withColumn("message", F.when(F.col("passed"), F.lit(None).cast("string")).otherwise(F.lit(texts[-1] if texts else "Assertion failed")))


def summarize_policy(results: DataFrame) -> DataFrame:
    out = results.groupBy("policy_id").agg(
        F.count_if("passed").alias("success_count"), F.count_if(~F.col("passed")).alias("failure_count"))
    return out.withColumn("score", score_expr(F.col("success_count"), F.col("success_count") + F.col("failure_count")))


def rule_actions(entities: DataFrame, rule: Rule) -> DataFrame:
    """The action table: which action applies to which entity, in order."""
    pack = lambda acts: F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(a.kind).alias("action"), F.lit(a.key).cast("string").alias("key"), F.lit(a.value).cast("string").alias("value"))
        for i, a in enumerate(acts)
    ]) if acts else F.array().cast("array<struct<seq:int,action:string,key:string,value:string>>")
    passed = F.coalesce(rule.assertion, F.lit(False))
    rows = match_entities(entities, rule.match_type, rule.where).withColumn("passed", passed)
    return rows.select(
        F.col("id").alias("object_id"), "passed", F.explode(F.when(F.col("passed"), pack(rule.on_pass)).otherwise(pack(rule.on_fail))).alias("a")
    ).select("object_id", "passed", "a.*")


def _without(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, v: k != key)


def apply_tag_actions(tags: Column, actions: tuple[Action, ...]) -> Column:
    """Tag map after ASSIGN_TAG and REMOVE_TAG, in order."""
    for a in actions:
        if a.kind in ("ASSIGN_TAG", "REMOVE_TAG"):
            tags = _without(tags, a.key)
        if a.kind == "ASSIGN_TAG":
            tags = F.map_concat(tags, F.create_map(F.lit(a.key), F.lit(a.value)))
    return tags


def compliance_stats(policies: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean latest score over all policies (no run counts 0), active policies, critical ones below 70."""
    last = first_per_key(runs, ["policy_id"], [F.col("started_at").desc(), F.col("id").desc()]).select("policy_id", "score")
    scored = policies.join(last, policies.id == last.policy_id, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.agg(
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 2).alias("overall_compliance"),
        F.count_if("is_active").alias("active_policies"),
        F.count_if((F.col("severity") == "critical") & (F.col("score") < 70)).alias("critical_issues"),
    )


def compliance_trend(runs: DataFrame, days: int, as_of) -> DataFrame:
    """Mean score per day for the ``days`` days up to ``as_of``; days without runs are 0.0."""
    spark = runs.sparkSession
    end = F.lit(as_of).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    daily = runs.filter(F.col("started_at") >= F.date_sub(end, days - 1).cast("timestamp_ntz")).groupBy(
        F.col("started_at").cast("date").alias("day")).agg(F.round(F.avg("score"), 2).alias("score"))
    return calendar.join(daily, "day", "left").fillna({"score": 0.0})


def run_results(results: DataFrame, run_id, only_failed: bool = False, limit: int | None = None) -> DataFrame:
    out = results.filter(F.col("run_id") == run_id)
    out = out.filter(~F.col("passed")) if only_failed else out
    out = out.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    out = runs.orderBy(F.col("started_at").desc(), F.col("id").desc())
    return out if limit is None else out.limit(limit)
