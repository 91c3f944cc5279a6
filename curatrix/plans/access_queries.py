"""Registered queries: filters, visibility and paging."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from curatrix.functions import predicates as p
from curatrix.operators import access as ac
from curatrix.plans.registry import query

_AUDIT = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND feature = 'click' AND success"
_AUDIT_ARGS = {"start": datetime(2024, 1, 5), "end": datetime(2024, 1, 20), "feature": "click", "success": True}


@query("filter_audit", "F13", f"SELECT id, ts, username, action FROM {{audit}} WHERE {_AUDIT} ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 20")
def filter_audit(d):
    return ac.audit_page(d["audit"], 20, 40, **_AUDIT_ARGS).select("id", "ts", "username", "action")


@query("count_audit", "F13", f"SELECT COUNT(*) AS total FROM {{audit}} WHERE {_AUDIT}")
def count_audit(d):
    return ac.audit_count(d["audit"], **_AUDIT_ARGS)


@query("page_products", "W7", """
SELECT id, name, (SELECT COUNT(*) FROM {products}) AS total_count, 65 < (SELECT COUNT(*) FROM {products}) AS has_more FROM {products} ORDER BY name, id LIMIT 25 OFFSET 40""")
def page_products(d):
    return ac.page(d["products"].select("id", "name"), ["name", "id"], 40, 25)


@query("visible_products", "F14", """
SELECT id, publication_scope FROM {products} WHERE publication_scope <> 'none' OR (draft_owner IS NULL AND project_id IN (3, 7, 11)) OR draft_owner = 'user4'""")
def visible_products(d):
    return ac.visible_products(d["products"], "user4", [3, 7, 11]).select("id", "publication_scope")


@query("visible_comments", "F15", """
SELECT id, project_id, audience_csv FROM {comments} WHERE status = 'active' AND (project_id = 4 OR project_id IS NULL)
 AND (audience_csv IS NULL OR list_has_any(string_split(audience_csv, ','), ['en', 'team:src3', 'team:src5', 'role:fr']))""")
def visible_comments(d):
    c = d["comments"].withColumn("audience", F.split("audience_csv", ","))
    return ac.visible_comments(c, 4, ["en"], ["src3", "src5"], "fr").select("id", "project_id", "audience_csv")


@query("accessible_assets", "F16", """
SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT asset_id FROM {ports} WHERE product_id IN (SELECT id FROM {products} WHERE owner = 'owner7' AND status = 'F'))""")
def accessible_assets(d):
    assets = d["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ac.accessible_assets(assets, d["products"].filter("owner = 'owner7' AND status = 'F'"), d["ports"])


_NOW = datetime(1999, 6, 1)


@query("grants_active", "F17", "SELECT id, grantee FROM {grants} WHERE status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1999-06-01')")
def grants_active(d):
    return ac.grants_active(d["grants"], _NOW).select("id", "grantee")


@query("grants_expiring", "F17", """
SELECT id, expires_at FROM {grants} WHERE status = 'ACTIVE' AND expires_at > TIMESTAMP '1999-06-01' AND expires_at <= TIMESTAMP '1999-06-15'""")
def grants_expiring(d):
    return ac.grants_expiring(d["grants"], _NOW, 14).select("id", "expires_at")


@query("grants_expired", "F17", "SELECT id, expires_at FROM {grants} WHERE status = 'ACTIVE' AND expires_at <= TIMESTAMP '1999-06-01'")
def grants_expired(d):
    return ac.grants_expired(d["grants"], _NOW).select("id", "expires_at")


@query("costs_in_month", "F18", "SELECT id, amount_cents FROM {cost_items} WHERE start_month <= DATE '1998-03-01' AND (end_month IS NULL OR end_month >= DATE '1998-03-01')")
def costs_in_month(d):
    return ac.costs_in_month(d["cost_items"], date(1998, 3, 1)).select("id", "amount_cents")


@query("facet_filter", "F19", """
SELECT table_full_name, column_name FROM {asset_columns} WHERE lower(split_part(table_full_name, '.', 1)) = 'cat1' AND lower(split_part(table_full_name, '.', 2)) = 'gold'
 AND lower(split_part(table_full_name, '.', 3)) IN ('t_4', 't_10', 't_16') AND lower(asset_type) = 'view'""")
def facet_filter(d):
    cols = ac.with_name_parts(d["asset_columns"])
    out = [ac.facet_filter(cols, "CAT1", "Gold", t, "VIEW") for t in ("t_4", "CAT1.gold.t_10", "T_16")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("table_full_name", "column_name")


@query("search_columns", "F20", """
SELECT table_full_name, column_name FROM {asset_columns} WHERE contains(lower(column_name), 'l_15') OR contains(lower(label), 'l_15') OR contains(lower(COALESCE(description, '')), 'l_15')
 OR contains(lower(table_full_name), 'l_15') OR contains(lower(system), 'l_15') OR contains(lower(term_iri), 'l_15')
UNION ALL SELECT table_full_name, column_name FROM {asset_columns} WHERE contains(lower(term_iri), 'brand#7') AND lower(column_name) NOT LIKE '%l_15%'""")
def search_columns(d):
    cols = ac.with_name_parts(d["asset_columns"]).withColumn("terms", F.array("term_iri"))
    a = ac.search_columns(cols, " L_15 ", "terms")
    b = ac.search_columns(cols, "Brand#7", "terms").filter(~F.lower("column_name").contains("l_15"))
    return a.unionByName(b).select("table_full_name", "column_name")


@query("name_patterns", "F21", """
SELECT c_custkey AS id, true AS everything, regexp_matches(c_name, '^Customer#0+1') AS regex, c_name LIKE 'Customer#%9' AS glob, c_name = 'Customer#000000012' AS exact, false AS empty FROM customer""")
def name_patterns(d):
    n = F.col("c_name")
    pats = {"everything": "*", "regex": "^Customer#0+1", "glob": "Customer#*9", "exact": "Customer#000000012", "empty": ""}
    return d["customer"].select(F.col("c_custkey").alias("id"), *[p.name_matches(n, v).alias(k) for k, v in pats.items()])


@query("tag_query", "F22", """
SELECT p_partkey AS id, lower(p_brand || '/' || p_type) = 'brand#7/small' OR lower('Type/' || p_type) = 'brand#7/small' AS exact,
 lower(p_brand || '/' || p_type) LIKE 'brand#1/%' AS prefix FROM part""")
def tag_query(d):
    tags = F.array(F.concat_ws("/", "p_brand", "p_type"), F.concat(F.lit("Type/"), F.col("p_type")))
    return d["part"].withColumn("tags", tags).select(F.col("p_partkey").alias("id"), p.tag_query(F.col("tags"), "Brand#7/SMALL").alias("exact"), p.tag_query(F.col("tags"), "Brand#1").alias("prefix"))


@query("expand_ancestors", "F24", """
SELECT path, CAST(depth AS INT) AS depth, bool_or(depth = n) AS selected FROM (
 SELECT array_to_string(p[1:i], '.') AS path, i AS depth, len(p) AS n FROM (SELECT string_split(location, '.') AS p FROM {assets} WHERE location IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(p))) AS i))
GROUP BY path, depth""")
def expand_ancestors(d):
    return ac.expand_ancestors(d["assets"].filter("location IS NOT NULL").select(F.col("location").alias("path")))


@query("entities_for_tag", "F25", "SELECT entity_type, entity_id, assigned_value FROM {tag_assoc} WHERE tag_id = 17 AND entity_type = 'table'")
def entities_for_tag(d):
    return ac.entities_for_tag(d["tag_assoc"], 17, "table").select("entity_type", "entity_id", "assigned_value")


_PLACES = """SELECT c_custkey AS k, c_name AS name, CASE c_nationkey % 4 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' ELSE 'small_airport' END AS type,
 CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'IA' || chr(CAST(65 + c_custkey % 26 AS INT)) END AS iata, 'IC' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_nationkey AS INT)) AS icao,
 CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS scheduled FROM {customer}"""


@query("reference_top_n", "F27", f"""
SELECT icao, iata, name, CASE type WHEN 'large_airport' THEN 'large' ELSE 'medium' END AS size_class FROM ({_PLACES})
WHERE type <> 'small_airport' AND length(iata) = 3 AND scheduled = 'yes' ORDER BY type, name, icao LIMIT 100""")
def reference_top_n(d):
    return ac.reference_top_n(d.sql(_PLACES), 100)


@query("match_triggers", "F28", """
SELECT e.id AS event_id, w.id AS workflow_id FROM {trigger_events} e JOIN {workflows} w ON e.trigger_type = w.trigger_type AND e.entity_type = w.entity_type AND w.is_active
 AND (e.trigger_type <> 'on_status_change' OR ((w.from_status IS NULL OR e.from_status IS NULL OR w.from_status = e.from_status) AND (w.to_status IS NULL OR e.to_status IS NULL OR w.to_status = e.to_status)))""")
def match_triggers(d):
    return ac.match_triggers(d["trigger_events"], d["workflows"])


@query("visible_projects", "F29", """
WITH mine AS (SELECT DISTINCT team_id FROM {team_members} WHERE lower(member) IN ('user7', 'user9')),
 doms AS (SELECT DISTINCT domain_id FROM {teams} WHERE team_id IN (SELECT team_id FROM mine) AND domain_id IS NOT NULL)
SELECT DISTINCT p.id, p.name FROM {projects} p LEFT JOIN {teams} t ON t.team_id = p.owner_team_id
WHERE t.domain_id IS NULL OR t.domain_id IN (SELECT domain_id FROM doms) OR p.id IN (SELECT project_id FROM {project_teams} WHERE team_id IN (SELECT team_id FROM mine))""")
def visible_projects(d):
    return ac.visible_projects(d["projects"], d["teams"], d["team_members"], d["project_teams"], "USER7", ["user9"])


@query("filter_assets", "F30", """
SELECT id, name, type FROM {assets} WHERE type IN ('Table', 'View') AND domain = 'domain4' AND status = 'active' AND name ILIKE '%RED%' AND id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def filter_assets(d):
    ids = d["lineitem"].filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return ac.filter_assets(d["assets"], types=["Table", "View"], domain="domain4", status="active", name="RED", restrict=ids).select("id", "name", "type")


@query("published_products", "F31", "SELECT id, name FROM {products} WHERE lower(publication_scope) = 'domain'")
def published_products(d):
    return ac.published_products(d["products"], "DOMAIN").select("id", "name")
