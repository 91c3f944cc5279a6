"""Filters over governance frames: audit, visibility, grants, costs, facets, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ntz(value) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def filter_audit(df: DataFrame, start=None, end=None, user=None, feature=None, action=None, success=None) -> DataFrame:
    """Conjunction of the filters that are given; typed literals so that Parquet can skip row groups."""
    conds = []
    if start is not None:
        conds.append(F.col("ts") >= _ntz(start))
    if end is not None:
        conds.append(F.col("ts") <= _ntz(end))
    for name, value in (("username", user), ("feature", feature), ("action", action), ("success", success)):
        if value is not None:
            conds.append(F.col(name) == F.lit(value))
    return reduce(DataFrame.filter, conds, df)


def audit_page(df: DataFrame, skip: int = 0, limit: int | None = None, **filters) -> DataFrame:
    rows = filter_audit(df, **filters).orderBy(F.col("ts").desc(), F.col("id").desc()).offset(skip)
    return rows if limit is None else rows.limit(limit)


def audit_count(df: DataFrame, **filters) -> DataFrame:
    """The count ignores paging."""
    return filter_audit(df, **filters).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows with the total and whether more follow, as columns."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total)
    return rows.withColumn("has_more", F.lit(offset + limit) < F.col("total_count"))


def visible_products(df: DataFrame, user: str, projects: list) -> DataFrame:
    published = F.col("publication_scope").isNotNull() & (F.col("publication_scope") != "none")
    own_project = F.col("draft_owner").isNull() & F.col("project_id").isin(list(projects))
    seen = published | own_project | (F.col("draft_owner") == user)
    return df.filter(F.coalesce(seen, F.lit(False)))


def visible_comments(df: DataFrame, project, groups: list[str], teams: list[str], role: str | None) -> DataFrame:
    """Active comments of the project or of none, whose audience is open or meets one of the reader's tokens."""
    tokens = [*groups, *[f"team:{t}" for t in teams], *([f"role:{role}"] if role else [])]
    in_project = F.col("project_id").isNull() if project is None else (F.col("project_id") == project) | F.col("project_id").isNull()
    open_to_all = F.col("audience").isNull()
    meets = F.arrays_overlap("audience", F.array(*map(F.lit, tokens))) if tokens else F.lit(False)
    return df.filter((F.col("status") == "active") & in_project & (open_to_all | F.coalesce(meets, F.lit(False))))


def accessible_assets(assets: DataFrame, products: DataFrame, ports: DataFrame) -> DataFrame:
    """Assets that a port of an accessible product delivers."""
    reachable = ports.join(products, ports.product_id == products.id, "left_semi").select(F.col("asset_id").alias("id"))
    return assets.join(reachable, "id", "left_semi")


def grants_active(df: DataFrame, as_of) -> DataFrame:
    return df.filter((F.col("status") == "ACTIVE") & (F.col("expires_at").isNull() | (F.col("expires_at") > _ntz(as_of))))


def grants_expiring(df: DataFrame, as_of, days: int) -> DataFrame:
    until = _ntz(as_of) + F.expr(f"interval {int(days)} days")
    rows = df.filter((F.col("status") == "ACTIVE") & (F.col("expires_at") > _ntz(as_of)) & (F.col("expires_at") <= until))
    return rows.orderBy("expires_at", "id")


def grants_expired(df: DataFrame, as_of) -> DataFrame:
    return df.filter((F.col("status") == "ACTIVE") & (F.col("expires_at") <= _ntz(as_of))).orderBy("expires_at", "id")


def costs_in_month(df: DataFrame, month) -> DataFrame:
    m = F.lit(month).cast("date")
    return df.filter((F.col("start_month") <= m) & (F.col("end_month").isNull() | (F.col("end_month") >= m)))


def facet_filter(columns: DataFrame, catalog=None, schema=None, table=None, asset_type=None, system=None) -> DataFrame:
    """Case-insensitive equality per facet; a table matches by full or short name."""
    same = lambda c, v: F.lower(F.col(c)) == v.lower()
    conds = [same(c, v) for c, v in (("catalog_name", catalog), ("schema_name", schema), ("asset_type", asset_type), ("system", system)) if v]
    if table:
        conds.append(same("table_full_name", table) | same("table_name", table))
    return reduce(DataFrame.filter, conds, columns)


def with_name_parts(columns: DataFrame) -> DataFrame:
    parts = F.split("table_full_name", r"\.")
    return columns.select("*", parts[0].alias("catalog_name"), parts[1].alias("schema_name"), parts[2].alias("table_name"))


# Text fields of a column entry that the column search looks at.
SEARCH_FIELDS = ("column_name", "description", "label", "table_name", "contract_name", "system", "catalog_name", "schema_name")


def search_columns(columns: DataFrame, q: str, terms: str | None = None) -> DataFrame:
    """Case-insensitive substring over the fields of a column entry and its business terms; empty text finds nothing."""
    want = q.strip().lower()
    if not want:
        return columns.limit(0)
    hits = [F.lower(F.col(c)).contains(want) for c in SEARCH_FIELDS if c in columns.columns]
    if terms:
        hits.append(F.exists(F.col(terms), lambda t: F.lower(t).contains(want)))
    return columns.filter(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def expand_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every selected dotted path and its prefixes, once, ancestors first; ``selected`` marks the ones asked for."""
    parts = F.split(F.col(path), r"\.")
    rows = paths.select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select(
        F.array_join(F.slice("p", F.lit(1), F.col("depth")), ".").alias("path"), "depth", (F.col("depth") == F.size("p")).alias("sel"))
    return rows.groupBy("path", "depth").agg(F.max("sel").alias("selected")).orderBy("depth", "path")


def entities_for_tag(assoc: DataFrame, tag_id, entity_type: str | None = None) -> DataFrame:
    out = assoc.filter(F.col("tag_id") == tag_id)
    return out.filter(F.col("entity_type") == entity_type) if entity_type else out


def reference_top_n(places: DataFrame, n: int) -> DataFrame:
    """Scheduled large and medium places with well-formed codes: size rank, then name; the first ``n``."""
    rank = F.when(F.col("type") == "large_airport", 0).when(F.col("type") == "medium_airport", 1)
    ok = rank.isNotNull() & F.col("iata").rlike("^[A-Z]{3}$") & F.col("icao").rlike("^[A-Z]{4}$") & (F.col("scheduled") == "yes")
    size = F.when(rank == 0, "large").otherwise("medium")
    return places.filter(ok).withColumn("size_class", size).orderBy(rank, "name", "icao").limit(n).select("icao", "iata", "name", "size_class")


def match_triggers(events: DataFrame, workflows: DataFrame) -> DataFrame:
    """(event, workflow) pairs that fire: active definition, same trigger and entity type, status conditions where given.

    Status conditions count for status-change triggers only, and only when the event states the status too.
    """
    e, w = events.alias("e"), workflows.filter("is_active").alias("w")
    fits = lambda c: F.col(f"w.{c}").isNull() | F.col(f"e.{c}").isNull() | (F.col(f"w.{c}") == F.col(f"e.{c}"))
    status_trigger = F.col("e.trigger_type").isin("on_status_change", "before_status_change")
    on = (
        (F.col("e.trigger_type") == F.col("w.trigger_type"))
        & (F.col("e.entity_type") == F.col("w.entity_type"))
        & (~status_trigger | (fits("from_status") & fits("to_status")))
    )
    return e.join(w, on).select(F.col("e.id").alias("event_id"), F.col("w.id").alias("workflow_id"))


def visible_projects(projects: DataFrame, teams: DataFrame, members: DataFrame, assoc: DataFrame, user: str, groups: list[str]) -> DataFrame:
    """Projects without a domain, of the user's teams, or in the domains of those teams; by name.

    ``projects``: id, name, owner_team_id.  ``teams``: team_id, domain_id.  ``members``: team_id, member.  ``assoc``: project_id, team_id.
    """
    me = [x.lower() for x in (user, *groups)]
    mine = members.filter(F.lower("member").isin(me)).select("team_id").distinct()
    my_domains = teams.join(mine, "team_id", "left_semi").filter("domain_id IS NOT NULL").select("domain_id", F.lit(True).alias("in_my_domain")).distinct()
    joined = assoc.join(mine, "team_id", "left_semi").select(F.col("project_id").alias("id"), F.lit(True).alias("joined")).distinct()
    owner = teams.select(F.col("team_id").alias("owner_team_id"), "domain_id")
    seen = projects.join(owner, "owner_team_id", "left").join(my_domains, "domain_id", "left").join(joined, "id", "left")
    keep = F.col("domain_id").isNull() | F.coalesce("joined", F.lit(False)) | F.coalesce("in_my_domain", F.lit(False))
    return seen.filter(keep).select("id", "name").orderBy("name", "id")


def filter_assets(df: DataFrame, types=None, platform=None, domain=None, status=None, name=None, restrict: DataFrame | None = None) -> DataFrame:
    """Conjunctive filters; ``restrict`` (ids) keeps only its ids, so an empty frame yields nothing and None no restriction."""
    out = df.filter(F.col("type").isin(list(types))) if types else df
    for col, value in (("platform", platform), ("domain", domain), ("status", status)):
        out = out.filter(F.col(col) == value) if value is not None else out
    out = out.filter(F.lower("name").contains(name.lower())) if name else out
    return out if restrict is None else out.join(restrict, "id", "left_semi")


def published_products(df: DataFrame, scope: str | None = None) -> DataFrame:
    out = df.filter(F.col("publication_scope").isNotNull() & (F.lower("publication_scope") != "none"))
    return out.filter(F.lower("publication_scope") == scope.lower()) if scope else out
