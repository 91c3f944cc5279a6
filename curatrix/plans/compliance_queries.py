"""Registered queries: rule predicates and compliance policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import predicates as p
from curatrix.operators import compliance as co
from curatrix.operators.compliance import Action, Rule
from curatrix.plans.registry import query


def with_tags(d):
    """Entities with their tags as a map."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))) for k, c in (("env", "tag_env"), ("tier", "tag_tier"))])
    return d["entities"].withColumn("tags", F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull())))


def _bools(df, **cols):
    return df.select("id", *[c.alias(n) for n, c in cols.items()])


@query("predicate_equality", "F1 F2", """
SELECT id, owner IS NOT DISTINCT FROM 'user1' AS eq, owner IS DISTINCT FROM 'user1' AS ne, owner IS NOT DISTINCT FROM tag_env AS eq_cols,
 COALESCE(amount > 100000, false) AS gt, COALESCE(owner >= 'user2', false) AS ge, COALESCE(tag_tier < 'tier2', false) AS lt FROM {entities}""")
def predicate_equality(d):
    c = F.col
    return _bools(d["entities"], eq=p.equals(c("owner"), "user1"), ne=p.differs(c("owner"), "user1"), eq_cols=p.equals(c("owner"), c("tag_env")),
                  gt=p.compare(c("amount"), ">", 100000), ge=p.compare(c("owner"), ">=", "user2"), lt=p.compare(c("tag_tier"), "<", "tier2"))


@query("predicate_text", "F3 F4 F5 F9", """
SELECT id, COALESCE(regexp_matches(name, '^(?:order_[0-9]*5)'), false) AS matches, COALESCE(regexp_matches(owner, '^(?:r1)'), false) AS anchored,
 COALESCE(tag_env IN ('prod', 'test'), false) AS member, COALESCE(contains(owner, 'r1'), false) AS contains,
 CAST(COALESCE(length(owner), 0) AS BIGINT) AS len, COALESCE(upper(owner), '') AS up, COALESCE(lower(name), '') AS low FROM {entities}""")
def predicate_text(d):
    c = F.col
    return _bools(d["entities"], matches=p.matches(c("name"), "order_[0-9]*5"), anchored=p.matches(c("owner"), "r1"),
                  member=p.member_of(c("tag_env"), ["prod", "test"]), contains=p.contains(c("owner"), "r1"),
                  len=p.length0(c("owner")).cast("bigint"), up=p.upper0(c("owner")), low=p.lower0(c("name")))


@query("predicate_tags", "F5 F8 F10", """
SELECT id, tag_env IS NOT NULL AS has_env, tag_tier AS tier, tag_env IS NOT NULL AS map_contains, status AS prop_status,
 CAST(NULL AS VARCHAR) AS prop_missing, COALESCE(tag_env = 'prod', false) AS values_have FROM {entities}""")
def predicate_tags(d):
    e = with_tags(d)
    c = F.col
    mtype = T.MapType(T.StringType(), T.StringType())
    return _bools(e, has_env=p.has_tag(c("tags"), "env"), tier=p.tag(c("tags"), "tier"), map_contains=p.contains(c("tags"), "env", mtype),
                  prop_status=p.prop(e, "obj.status", "tags"), prop_missing=p.prop(e, "obj.nothing", "tags"),
                  values_have=p.contains(F.map_values("tags"), "prod", T.ArrayType(T.StringType())))


@query("predicate_logic", "F6 F7", """
SELECT id, (COALESCE(length(owner), 0) > 0) AND (id <> 0) AS both_truthy, (tag_env = 'prod') IS TRUE OR NOT (COALESCE(status = 'F', false)) AS either,
 CASE WHEN amount > 300000 THEN 'big' WHEN amount > 100000 THEN 'mid' END AS size_class, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM {entities}""")
def predicate_logic(d):
    c = F.col
    return _bools(d["entities"], both_truthy=p.truthy(c("owner"), T.StringType()) & p.truthy(c("id"), T.LongType()),
                  either=p.equals(c("tag_env"), "prod") | ~p.equals(c("status"), "F"),
                  size_class=p.case(None, [(p.compare(c("amount"), ">", 300000), "big"), (p.compare(c("amount"), ">", 100000), "mid")]),
                  code=p.case(c("status"), [(F.lit("F"), 1), (F.lit("O"), 2)], 0))


@query("registered_predicate", "UD3", "SELECT id, regexp_matches(name, '^[a-z][a-z0-9_]*$') AS snake_case FROM {entities}")
def registered_predicate(d):
    p.register_predicate("IS_SNAKE_CASE", lambda c: F.coalesce(c.rlike("^[a-z][a-z0-9_]*$"), F.lit(False)))
    return _bools(d["entities"], snake_case=p.call_predicate("is_snake_case", F.col("name")))


def _naming_rule():
    return Rule(
        "Object", p.matches(F.col("name"), "[a-z][a-z0-9_]*$") & p.differs(F.col("owner"), None),
        where=F.col("type").isin("table", "view"),
        on_pass=(Action("PASS"), Action("ASSIGN_TAG", "naming", "ok")),
        on_fail=(Action("FAIL", value="Name must be snake_case and owned"), Action("REMOVE_TAG", "env"), Action("NOTIFY", value="stewards")))


_PASS = "(regexp_matches(name, '^(?:[a-z][a-z0-9_]*$)') AND owner IS NOT NULL)"


@query("match_entities", "F11", "SELECT id, type, name FROM {entities} WHERE type IN ('schema', 'table', 'view', 'data_product') AND COALESCE(tag_env = 'prod', false)")
def match_entities(d):
    return co.match_entities(with_tags(d), "Object", p.tag(F.col("tags"), "env") == "prod").select("id", "type", "name")


@query("evaluate_policy", "AG1", f"""
SELECT 'naming' AS policy_id, id AS object_id, type, name, {_PASS} AS passed, CASE WHEN {_PASS} THEN NULL ELSE 'Name must be snake_case and owned' END AS message
FROM {{entities}} WHERE type IN ('table', 'view')""")
def evaluate_policy(d):
    return co.evaluate_policy(d["entities"], _naming_rule(), "naming")


@query("policy_score", "AG1", f"""
SELECT 'naming' AS policy_id, COUNT(*) FILTER ({_PASS}) AS success_count, COUNT(*) FILTER (NOT {_PASS}) AS failure_count,
 ROUND(100.0 * COUNT(*) FILTER ({_PASS}) / COUNT(*), 2)::DOUBLE AS score FROM {{entities}} WHERE type IN ('table', 'view')""")
def policy_score(d):
    return co.summarize_policy(co.evaluate_policy(d["entities"], _naming_rule(), "naming"))


@query("rule_actions", "UD4", f"""
SELECT id AS object_id, {_PASS} AS passed, a.seq, a.action, a.key, a.value FROM {{entities}},
 (VALUES (true, 0, 'PASS', NULL, NULL), (true, 1, 'ASSIGN_TAG', 'naming', 'ok'), (false, 0, 'FAIL', NULL, 'Name must be snake_case and owned'),
  (false, 1, 'REMOVE_TAG', 'env', NULL), (false, 2, 'NOTIFY', NULL, 'stewards')) AS a(ok, seq, action, key, value)
WHERE type IN ('table', 'view') AND a.ok = {_PASS}""")
def rule_actions(d):
    return co.rule_actions(d["entities"], _naming_rule())


@query("apply_tag_actions", "UD4", """
SELECT id, tag_tier AS tier, CASE WHEN status = 'F' THEN 'ok' END AS naming, CASE WHEN status = 'F' THEN tag_env END AS env FROM {entities}""")
def apply_tag_actions(d):
    rule = _naming_rule()
    after = F.when(F.col("status") == "F", co.apply_tag_actions(F.col("tags"), rule.on_pass)).otherwise(co.apply_tag_actions(F.col("tags"), rule.on_fail))
    e = with_tags(d).withColumn("tags", after)
    return e.select("id", *[p.tag(F.col("tags"), k).alias(k) for k in ("tier", "naming", "env")])


@query("select_policies", "F12", """
SELECT id, name, category, severity FROM {policies} WHERE is_active AND category IN ('SMALL', 'LARGE') AND severity IN ('critical', 'high')""")
def select_policies(d):
    return co.select_policies(d["policies"], "active", categories=["SMALL", "LARGE"], severities=["critical", "high"]).select("id", "name", "category", "severity")


_LATEST = "(SELECT * FROM {policy_runs} QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_id ORDER BY started_at DESC, id DESC) = 1)"


@query("compliance_stats", "AG2", f"""
SELECT ROUND(AVG(COALESCE(r.score, 0)), 2) AS overall_compliance, COUNT(*) FILTER (is_active) AS active_policies,
 COUNT(*) FILTER (severity = 'critical' AND COALESCE(r.score, 0) < 70) AS critical_issues FROM {{policies}} p LEFT JOIN {_LATEST} r ON r.policy_id = p.id""")
def compliance_stats(d):
    return co.compliance_stats(d["policies"], d["policy_runs"])


@query("compliance_trend", "AG3", """
SELECT CAST(c.day AS DATE) AS day, COALESCE(r.score, 0.0) AS score FROM generate_series(TIMESTAMP '2024-01-12', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) c(day)
LEFT JOIN (SELECT CAST(started_at AS DATE) AS day, ROUND(AVG(score), 2) AS score FROM {policy_runs} GROUP BY 1) r ON r.day = CAST(c.day AS DATE)""")
def compliance_trend(d):
    return co.compliance_trend(d["policy_runs"], 30, datetime(2024, 2, 10))


def _results(d):
    r = d["policy_runs"]
    return r.select("id", F.col("policy_id").alias("run_id"), (F.col("status") == "succeeded").alias("passed"), F.col("started_at").alias("created_at"))


@query("run_results", "F26", """

SELECT id, started_at AS created_at FROM {policy_runs} WHERE policy_id = 7 AND status = 'failed'""")
def run_results(d):
    return co.run_results(_results(d), 7, only_failed=True).select("id", "created_at")


@query("recent_runs", "F26", "SELECT id, policy_id, score FROM {policy_runs} ORDER BY started_at DESC, id DESC LIMIT 50")
def recent_runs(d):
    return co.recent_runs(d["policy_runs"], 50).select("id", "policy_id", "score")
