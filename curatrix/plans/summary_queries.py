"""Registered queries: reporting, costs, grants, versions, retention, star-schema views."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from curatrix.operators import summaries as sm
from curatrix.plans.registry import query

_LAST_Q = "(SELECT * FROM {quality_items} QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_type, entity_id, dimension ORDER BY measured_at DESC, id DESC) = 1)"


@query("quality_summary", "AG4 J9", f"""
SELECT l.entity_type, l.entity_id, l.overall_score, l.dimensions, i.items FROM (SELECT entity_type, entity_id, ROUND(AVG(score_percent), 6) AS overall_score, COUNT(*) AS dimensions FROM {_LAST_Q} GROUP BY 1, 2) l
JOIN (SELECT entity_type, entity_id, COUNT(*) AS items FROM {{quality_items}} GROUP BY 1, 2) i USING (entity_type, entity_id)""")
def quality_summary(d):
    return sm.quality_summary(d["quality_items"])


@query("quality_by_source", "AG4", f"SELECT entity_type, entity_id, source, ROUND(AVG(score_percent), 6) AS score FROM {_LAST_Q} GROUP BY 1, 2, 3")
def quality_by_source(d):
    return sm.quality_by_source(d["quality_items"])


@query("latest_quality", "J9", f"SELECT entity_type, entity_id, dimension, id, score_percent FROM {_LAST_Q}")
def latest_quality(d):
    return sm.latest_quality(d["quality_items"]).select("entity_type", "entity_id", "dimension", "id", "score_percent")


@query("product_quality", "AG5", """
WITH allq AS (SELECT entity_id AS product_id, * FROM {quality_items} WHERE entity_type = 'data_product'
 UNION ALL SELECT c.product_id, q.* FROM {quality_items} q JOIN {product_contracts} c ON q.entity_type = 'data_contract' AND c.contract_id = q.entity_id),
 last AS (SELECT * FROM allq QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id, entity_type, entity_id, dimension ORDER BY measured_at DESC, id DESC) = 1)
SELECT product_id, s.overall_score, n.items FROM (SELECT product_id, ROUND(AVG(s), 6) AS overall_score FROM (SELECT product_id, dimension, AVG(score_percent) AS s FROM last GROUP BY 1, 2) GROUP BY 1) s
JOIN (SELECT product_id, COUNT(*) AS items FROM allq GROUP BY 1) n USING (product_id)""")
def product_quality(d):
    return sm.product_quality(d["quality_items"], d["product_contracts"])


@query("cost_summary", "AG6 F18", """
SELECT entity_type, entity_id, COALESCE(cost_center, '') AS cost_center, CAST(SUM(amount_cents) AS BIGINT) AS amount_cents, COUNT(*) AS items, MAX(currency) AS currency FROM {cost_items}
WHERE start_month <= DATE '1998-03-01' AND (end_month IS NULL OR end_month >= DATE '1998-03-01') GROUP BY 1, 2, 3""")
def cost_summary(d):
    return sm.cost_summary(d["cost_items"], date(1998, 3, 1))


@query("cost_by_product", "AG7 J5 SC16", """
SELECT u.product_tag AS product, CAST(trunc(ROUND(SUM(u.usage_quantity * COALESCE(p.price, 0)), 6) * 100) AS BIGINT) AS amount_cents FROM {usage} u
LEFT JOIN {prices} p ON u.sku_name = p.sku_name AND u.usage_end_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)
WHERE u.usage_end_time >= DATE '2024-01-01' AND u.usage_end_time < DATE '2024-02-01' AND u.product_tag IS NOT NULL GROUP BY 1""")
def cost_by_product(d):
    return sm.cost_by_product(d["usage"], d["prices"], date(2024, 1, 15))


@query("rating_summary", "AG8", """
SELECT entity_id, COUNT(*) FILTER (rating = 1) AS stars_1, COUNT(*) FILTER (rating = 2) AS stars_2, COUNT(*) FILTER (rating = 3) AS stars_3, COUNT(*) FILTER (rating = 4) AS stars_4,
 COUNT(*) FILTER (rating = 5) AS stars_5, COUNT(rating) AS total_ratings, ROUND(AVG(rating), 2) AS average_rating,
 arg_max(rating, (created_at, id)) FILTER (created_by = 'u3') AS user_current_rating FROM {ratings} GROUP BY entity_id""")
def rating_summary(d):
    return sm.rating_summary(d["ratings"], "u3")


_DAYS = "COALESCE(c.warning_days, 7)"


@query("grant_summary", "AG9", f"""
SELECT entity_type, entity_id, COALESCE(active_grants, 0) AS active_grants, COALESCE(expiring_grants, 0) AS expiring_grants, COALESCE(total_grants, 0) AS total_grants, COALESCE(pending_requests, 0) AS pending_requests FROM (
 SELECT g.entity_type, entity_id, COUNT(*) FILTER (status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1999-06-01')) AS active_grants,
  COUNT(*) FILTER (status = 'ACTIVE' AND expires_at > TIMESTAMP '1999-06-01' AND expires_at <= TIMESTAMP '1999-06-01' + to_days({_DAYS})) AS expiring_grants, COUNT(*) AS total_grants
 FROM {{grants}} g LEFT JOIN {{grant_config}} c USING (entity_type) GROUP BY 1, 2)
FULL JOIN (SELECT entity_type, entity_id, COUNT(*) AS pending_requests FROM {{access_requests}} WHERE status = 'PENDING' GROUP BY 1, 2) USING (entity_type, entity_id)""")
def grant_summary(d):
    return sm.grant_summary(d["grants"], d["access_requests"], d["grant_config"], datetime(1999, 6, 1))


@query("expire_grants", "AG10", f"""
SELECT id, CASE WHEN status = 'ACTIVE' AND expires_at <= TIMESTAMP '1999-06-01' THEN 'EXPIRED' ELSE status END AS status,
 COALESCE(status = 'ACTIVE' AND expires_at > TIMESTAMP '1999-06-01' AND expires_at <= TIMESTAMP '1999-06-01' + to_days(least({_DAYS}, 7)), false) AS warn
FROM {{grants}} g LEFT JOIN {{grant_config}} c USING (entity_type)""")
def expire_grants(d):
    return sm.expire_grants(d["grants"], d["grant_config"], datetime(1999, 6, 1))


@query("contract_summary", "AG11 J1 J2", """
SELECT c.id, c.name, c.version, t.c_name AS team_name, n.n_name AS domain_name, COALESCE(o.n, 0) AS schema_count FROM {contracts} c
LEFT JOIN (SELECT contract_id, COUNT(*) AS n FROM {contract_objects} GROUP BY 1) o ON o.contract_id = c.id LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) t ON t.c_custkey = c.owner_team_id
LEFT JOIN nation n ON n.n_nationkey = c.domain_id""")
def contract_summary(d):
    teams = d["customer"].filter("c_acctbal > 0").select(F.col("c_custkey").alias("owner_team_id"), F.col("c_name").alias("team_name"))
    domains = d["nation"].select(F.col("n_nationkey").alias("domain_id"), F.col("n_name").alias("domain_name"))
    return sm.contract_summary(d["contracts"], d["contract_objects"], teams, domains)


_FIELDS = ["status", "domain", "tenant", "product_type", "owner"]


@query("distinct_values", "AG12", " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS field, {f} AS value FROM {{products}}" for f in _FIELDS))
def distinct_values(d):
    return sm.distinct_values(d["products"], _FIELDS)


@query("subscriber_counts", "AG13", "SELECT product_id, COUNT(*) AS subscribers FROM {subscriptions} GROUP BY 1")
def subscriber_counts(d):
    return sm.subscriber_counts(d["subscriptions"])


@query("table_list", "AG14", """
SELECT table_full_name, COUNT(*) AS column_count, arg_min(asset_type, column_name) AS asset_type, arg_min(system, column_name) AS system FROM {asset_columns} GROUP BY 1""")
def table_list(d):
    return sm.table_list(d["asset_columns"])


@query("facet_values", "AG15", """
SELECT DISTINCT 'asset_type' AS field, asset_type AS value FROM {asset_columns} UNION ALL SELECT DISTINCT 'system', system FROM {asset_columns}
UNION ALL SELECT DISTINCT 'catalog', split_part(table_full_name, '.', 1) FROM {asset_columns} UNION ALL SELECT DISTINCT 'schema', split_part(table_full_name, '.', 2) FROM {asset_columns}""")
def facet_values(d):
    parts = F.split("table_full_name", r"\.")
    cols = d["asset_columns"].select("asset_type", "system", parts[0].alias("catalog"), parts[1].alias("schema"))
    return sm.distinct_values(cols, ["asset_type", "system", "catalog", "schema"])


@query("latest_version", "W1", """
SELECT family, id, version FROM (SELECT COALESCE(base_name, name) AS family, * FROM {contracts}) QUALIFY ROW_NUMBER() OVER (PARTITION BY family ORDER BY created_at DESC, id DESC) = 1""")
def latest_version(d):
    return sm.latest_version(d["contracts"]).select("family", "id", "version")


_FAM = """c AS (SELECT id, COALESCE(base_name, name) AS family, COUNT(*) OVER (PARTITION BY COALESCE(base_name, name)) AS members, parent_contract_id AS par, version, created_at FROM {contracts})"""


@query("version_groups", "W2", f"""
WITH {_FAM}, g AS (SELECT par AS k FROM c WHERE members = 1 AND par IS NOT NULL UNION SELECT id FROM c WHERE members = 1)
SELECT 'name:' || family AS group_key, id, version, created_at FROM c WHERE members > 1
UNION ALL SELECT DISTINCT 'parent:' || k, id, version, created_at FROM c JOIN g ON c.par = g.k OR c.id = g.k""")
def version_groups(d):
    return sm.version_groups(d["contracts"])


def _family_sql(i):
    return f"""SELECT {i} AS wanted_id, c.id, c.version, c.created_at FROM c, (SELECT * FROM c WHERE id = {i}) me WHERE CASE WHEN me.members > 1 THEN c.family = me.family
 ELSE c.id = me.id OR COALESCE(c.id = me.par OR c.par = me.id OR c.par = me.par, false) END"""


@query("version_family", "W2", f"WITH {_FAM} {_family_sql(8)} UNION ALL {_family_sql(70)} UNION ALL {_family_sql(147)}")
def version_family(d):
    out = [sm.version_family(d["contracts"], i).withColumn("wanted_id", F.lit(i)) for i in (8, 70, 147)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("retain_sessions", "W4", """
SELECT id, user_id FROM (SELECT event_id AS id, user_id % 20 AS user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05') QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= 50""")
def retain_sessions(d):
    s = d["events"].select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("user_id"), F.col("ts").alias("updated_at"))
    return sm.retain(s, datetime(2024, 2, 4)).select("id", "user_id")
