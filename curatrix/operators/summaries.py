"""Catalog reporting: quality, cost, rating, grant and usage summaries, versions, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.scalar import month_end_exclusive, month_start
from curatrix.operators.access import costs_in_month
from curatrix.operators.linking import price_as_of
from curatrix.operators.skew import first_per_key


def latest_quality(items: DataFrame) -> DataFrame:
    """Newest item per entity and dimension; the higher id wins a tie."""
    return first_per_key(items, ["entity_type", "entity_id", "dimension"], [F.col("measured_at").desc(), F.col("id").desc()])


def quality_summary(items: DataFrame) -> DataFrame:
    """Per entity: mean of the latest score of every dimension, and the count of all items."""
    ent = ["entity_type", "entity_id"]
    overall = latest_quality(items).groupBy(*ent).agg(F.round(F.avg("score_percent"), 6).alias("overall_score"), F.count(F.lit(1)).alias("dimensions"))
    return overall.join(items.groupBy(*ent).agg(F.count(F.lit(1)).alias("items")), ent)


def quality_by_source(items: DataFrame) -> DataFrame:
    return latest_quality(items).groupBy("entity_type", "entity_id", "source").agg(F.round(F.avg("score_percent"), 6).alias("score"))


def product_quality(items: DataFrame, product_contracts: DataFrame) -> DataFrame:
    """Own items of a product and those of its contracts: latest per entity and dimension, mean per dimension, mean of those."""
    own = items.filter("entity_type = 'data_product'").withColumn("product_id", F.col("entity_id"))
    via = items.filter("entity_type = 'data_contract'").join(product_contracts.withColumnRenamed("contract_id", "entity_id"), "entity_id")
    allq = own.unionByName(via.select(*own.columns))
    last = first_per_key(allq, ["product_id", "entity_type", "entity_id", "dimension"], [F.col("measured_at").desc(), F.col("id").desc()])
    dims = last.groupBy("product_id", "dimension").agg(F.avg("score_percent").alias("s"))
    score = dims.groupBy("product_id").agg(F.round(F.avg("s"), 6).alias("overall_score"))
    return score.join(allq.groupBy("product_id").agg(F.count(F.lit(1)).alias("items")), "product_id")


def cost_summary(items: DataFrame, month) -> DataFrame:
    """Cents and items per entity and cost centre in a month; the total per entity is the sum of its rows."""
    return costs_in_month(items, month).groupBy("entity_type", "entity_id", F.coalesce("cost_center", F.lit("")).alias("cost_center")).agg(
        F.sum("amount_cents").alias("amount_cents"), F.count(F.lit(1)).alias("items"), F.max("currency").alias("currency"))


def cost_by_product(usage: DataFrame, prices: DataFrame, month, tag: str = "product_tag") -> DataFrame:
    """Month's cost per product in whole cents (truncated), from usage times the price valid at the time."""
    m = F.lit(month).cast("date")
    rows = usage.filter((F.col("usage_end_time") >= month_start(m)) & (F.col("usage_end_time") < month_end_exclusive(m)) & F.col(tag).isNotNull())
    priced = price_as_of(rows, prices)
    cost = priced.groupBy(F.col(tag).alias("product")).agg(F.sum(F.col("usage_quantity") * F.col("price")).alias("cost"))
    return cost.select("product", (F.round(F.col("cost"), 6) * 100).cast("bigint").alias("amount_cents"))


def rating_summary(ratings: DataFrame, user: str) -> DataFrame:
    """Distribution, total, mean and the user's latest rating, per entity."""
    stars = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in range(1, 6)]
    latest = F.max(F.when(F.col("created_by") == user, F.struct("created_at", "id", "rating")))
    out = ratings.groupBy("entity_id").agg(
        *stars, F.count("rating").alias("total_ratings"), F.round(F.coalesce(F.avg("rating"), F.lit(0.0)), 2).alias("average_rating"), latest.alias("_l"))
    return out.withColumn("user_current_rating", F.col("_l.rating")).drop("_l")


def grant_summary(grants: DataFrame, requests: DataFrame, config: DataFrame, as_of, default_days: int = 7) -> DataFrame:
    """Per entity: active, pending, expiring within the warning days of its type, and all grants."""
    now = F.lit(as_of).cast("timestamp_ntz")
    ent = ["entity_type", "entity_id"]
    g = grants.join(config, "entity_type", "left").withColumn("days", F.coalesce("warning_days", F.lit(default_days)))
    active = (F.col("status") == "ACTIVE") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    soon = active & (F.col("expires_at") <= now + F.make_dt_interval(F.col("days")))
    counts = g.groupBy(*ent).agg(
        F.count_if(active).alias("active_grants"), F.count_if(F.coalesce(soon, F.lit(False))).alias("expiring_grants"), F.count(F.lit(1)).alias("total_grants"))
    pending = requests.filter("status = 'PENDING'").groupBy(*ent).agg(F.count(F.lit(1)).alias("pending_requests"))
    zero = ["active_grants", "expiring_grants", "total_grants", "pending_requests"]
    return counts.join(pending, ent, "full").fillna(0, zero)


def expire_grants(grants: DataFrame, config: DataFrame, as_of, window_days: int = 7, default_days: int = 7) -> DataFrame:
    """New status of every grant, and whether its holder is to be warned."""
    now = F.lit(as_of).cast("timestamp_ntz")
    g = grants.join(config, "entity_type", "left").withColumn("days", F.coalesce("warning_days", F.lit(default_days)))
    due = (F.col("status") == "ACTIVE") & (F.col("expires_at") <= now)
    near = (F.col("status") == "ACTIVE") & (F.col("expires_at") > now) & (F.col("expires_at") <= now + F.make_dt_interval(F.least("days", F.lit(window_days))))
    return g.select(
        "id", F.when(due, "EXPIRED").otherwise(F.col("status")).alias("status"), F.coalesce(near, F.lit(False)).alias("warn"))


def contract_summary(contracts: DataFrame, objects: DataFrame, teams: DataFrame, domains: DataFrame) -> DataFrame:
    """Contracts with resolved names and their schema object count (0 when there is none)."""
    n = objects.groupBy("contract_id").agg(F.count(F.lit(1)).alias("schema_count"))
    out = contracts.join(n, contracts.id == n.contract_id, "left").join(teams, "owner_team_id", "left").join(domains, "domain_id", "left")
    return out.select("id", "name", "version", "team_name", "domain_name", F.coalesce("schema_count", F.lit(0)).alias("schema_count"))


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) for every distinct non-empty value, all fields in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.length("value") > 0)
    return rows.distinct().orderBy("field", "value")


def subscriber_counts(subs: DataFrame, key: str = "product_id") -> DataFrame:
    return subs.groupBy(key).agg(F.count(F.lit(1)).alias("subscribers"))


def table_list(columns: DataFrame) -> DataFrame:
    """Tables with their column count and the metadata of their first column (by name)."""
    return columns.groupBy("table_full_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.min_by(F.struct("asset_type", "system"), "column_name").alias("_m"),
    ).select("table_full_name", "column_count", "_m.asset_type", "_m.system")


def latest_version(contracts: DataFrame) -> DataFrame:
    """Newest contract per base name (or own name)."""
    c = contracts.withColumn("family", F.coalesce("base_name", "name"))
    return first_per_key(c, ["family"], [F.col("created_at").desc(), F.col("id").desc()])


def _families(contracts: DataFrame) -> DataFrame:
    c = contracts.select("id", F.coalesce("base_name", "name").alias("family"), "parent_contract_id", "version", "created_at")
    sizes = c.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    return c.join(sizes, "family")


def version_groups(contracts: DataFrame) -> DataFrame:
    """(group_key, id, version, created_at): contracts that belong together, one row per membership.

    Contracts that share the base name form a ``name:`` group.  A contract alone under its name belongs to the
    ``parent:`` groups of its parent and of itself, which hold the parent and all its children.  The memberships are
    linear in the contracts, where listing each contract's relatives would be quadratic.
    """
    c = _families(contracts)
    named = c.filter("members > 1").select(F.concat(F.lit("name:"), F.col("family")).alias("group_key"), "id", "version", "created_at")
    parent_key = lambda col: F.concat(F.lit("parent:"), F.col(col).cast("string")).alias("group_key")
    lone = c.filter("members = 1")
    groups = lone.filter("parent_contract_id IS NOT NULL").select(parent_key("parent_contract_id")).unionByName(lone.select(parent_key("id"))).distinct()
    rows = c.filter("parent_contract_id IS NOT NULL").select(parent_key("parent_contract_id"), "id", "version", "created_at").unionByName(
        c.select(parent_key("id"), "id", "version", "created_at"))
    return named.unionByName(rows.join(groups, "group_key", "left_semi").distinct())


def version_family(contracts: DataFrame, contract_id) -> DataFrame:
    """Every version that belongs with one contract, newest first: those of its name, else parent, children, siblings."""
    c = _families(contracts)
    me = c.filter(F.col("id") == F.lit(contract_id))
    one = lambda col: me.select(col).scalar()
    kin = (F.col("id") == one("parent_contract_id")) | (F.col("parent_contract_id") == F.lit(contract_id)) | (F.col("parent_contract_id") == one("parent_contract_id"))
    same = F.when(one("members") > 1, F.col("family") == one("family")).otherwise(F.coalesce(kin, F.lit(False)) | (F.col("id") == F.lit(contract_id)))
    return c.filter(same).select("id", "version", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc())


def retain(sessions: DataFrame, as_of, max_age_days: int = 30, max_per_user: int = 50) -> DataFrame:
    """Sessions that stay: young enough and among the newest of their user."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(max_age_days)} days")
    return first_per_key(sessions.filter(F.col("updated_at") >= cutoff), ["user_id"], [F.col("updated_at").desc(), F.col("id").desc()], max_per_user)
