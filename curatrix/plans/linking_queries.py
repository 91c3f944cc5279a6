"""Registered queries: joins between governance frames, and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import access as ac
from curatrix.operators import linking as lk
from curatrix.operators import tagging as tg
from curatrix.operators.skew import left_join_parts, salted_join
from curatrix.operators.tagging import DiscoveryPattern, TagConfig
from curatrix.plans.registry import query


@query("contract_with_objects", "J1", "SELECT c.id, c.name, o.id AS object_id, o.name AS object_name FROM {contracts} c JOIN {contract_objects} o ON o.contract_id = c.id")
def contract_with_objects(d):
    o = d["contract_objects"].select(F.col("contract_id").alias("id"), F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    return d["contracts"].select("id", "name").join(o, "id")


@query("objects_with_properties", "J2", """
SELECT o.id AS object_id, o.name, p.name AS property_name, p.logical_type FROM {contract_objects} o LEFT JOIN (SELECT * FROM {contract_properties} WHERE required) p ON p.object_id = o.id""")
def objects_with_properties(d):
    p = d["contract_properties"].filter("required").select("object_id", F.col("name").alias("property_name"), "logical_type")
    return left_join_parts(d["contract_objects"].select(F.col("id").alias("object_id"), "name"), p, ["object_id"])


@query("salted_order_lines", "J1 J2", "SELECT l_orderkey, l_linenumber, s_name, s_nationkey FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def salted_order_lines(d):
    left = d["lineitem"].select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    right = d["supplier"].filter("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey")
    busy = d.spark.createDataFrame([(1,), (2,), (7,)], "s_suppkey long")  # known to the caller
    return salted_join(left, right, ["s_suppkey"], "left", busy, 8).drop("s_suppkey")


_LINKS = """SELECT CAST(o_orderkey AS STRING) || '#tbl_' || CAST(o_custkey % 100 AS STRING) || '_1' AS entity_id, 'term:' || o_orderpriority AS iri FROM {orders}"""
_OPORTS = """SELECT l_orderkey AS contract_id, 'tbl_' || CAST(MIN(l_suppkey) AS STRING) || '_' || CAST(l_linenumber AS STRING) AS object_name, MIN(l_partkey) AS product_id FROM {lineitem}
 GROUP BY l_orderkey, l_linenumber"""
_PRODS = "SELECT p_partkey AS id, p_name AS name FROM {part} WHERE p_size % 2 = 0"
_DOMS = "SELECT n_nationkey AS domain_id, n_name AS domain_name FROM {nation} WHERE n_nationkey % 4 <> 0"


@query("contract_tag_sources", "J3", f"""
SELECT c.id AS contract_id, c.name AS contract_name, c.version, o.name AS object_name, o.physical_name, d.domain_name, p.name AS product_name, k.iri FROM {{contracts}} c
LEFT JOIN {{contract_objects}} o ON o.contract_id = c.id LEFT JOIN ({_DOMS}) d ON d.domain_id = c.domain_id LEFT JOIN ({_OPORTS}) t ON t.contract_id = c.id AND t.object_name = o.name
LEFT JOIN ({_PRODS}) p ON p.id = t.product_id LEFT JOIN ({_LINKS}) k ON k.entity_id = CAST(c.id AS VARCHAR) || '#' || o.name""")
def contract_tag_sources(d):
    out = lk.contract_tag_sources(d["contracts"], d["contract_objects"], d.sql(_DOMS), d.sql(_OPORTS), d.sql(_PRODS), d.sql(_LINKS))
    return out.select("contract_id", "contract_name", "version", "object_name", "physical_name", "domain_name", "product_name", "iri")


_RELS = """SELECT DISTINCT l_partkey AS source_id, l_orderkey AS target_id, CASE WHEN l_linenumber = 1 THEN 'governedBy' WHEN l_linenumber = 2 THEN 'partOf' ELSE 'uses' END AS relationship_type FROM {lineitem}"""
_ASSETS_D = "SELECT id, type, status, location, id % 25 AS domain_id FROM {assets}"
_DATASETS = "SELECT o_orderkey AS id, o_custkey AS product_id FROM {orders} WHERE o_orderstatus <> 'P'"
_CPROD = "SELECT c_custkey AS id, c_name AS name FROM {customer}"
_ALINKS = "SELECT p_partkey AS entity_id, 'term:' || p_brand AS iri FROM {part} WHERE p_size > 20"


@query("asset_tag_sources", "J4", f"""
SELECT a.id AS asset_id, a.type AS asset_type, a.location, d.domain_name, c.name AS contract_name, p.name AS product_name, k.iri FROM ({_ASSETS_D}) a
LEFT JOIN ({_DOMS}) d ON d.domain_id = a.domain_id LEFT JOIN ({_RELS}) g ON g.source_id = a.id AND g.relationship_type = 'governedBy' LEFT JOIN {{contracts}} c ON c.id = g.target_id
LEFT JOIN ({_RELS}) r ON r.source_id = a.id AND r.relationship_type = 'partOf' LEFT JOIN ({_DATASETS}) s ON s.id = r.target_id LEFT JOIN ({_CPROD}) p ON p.id = s.product_id
LEFT JOIN ({_ALINKS}) k ON k.entity_id = a.id WHERE a.type IN ('Table', 'View') AND a.status = 'active' AND a.location IS NOT NULL""")
def asset_tag_sources(d):
    out = lk.asset_tag_sources(d.sql(_ASSETS_D), d.sql(_RELS), d.sql(_DOMS), d["contracts"], d.sql(_DATASETS), d.sql(_CPROD), d.sql(_ALINKS))
    return out.select("asset_id", "asset_type", "location", "domain_name", "contract_name", "product_name", "iri")


@query("price_as_of", "J5", """
SELECT u.id, u.sku_name, COALESCE(p.price, 0) AS price FROM {usage} u LEFT JOIN {prices} p ON u.sku_name = p.sku_name AND u.usage_end_time >= p.price_start_time
 AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)""")
def price_as_of(d):
    return lk.price_as_of(d["usage"], d["prices"]).select("id", "sku_name", "price")


_SALES = "SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS sold_on, l_extendedprice AS amount, l_suppkey AS customer_id FROM {lineitem}"
_CAMPAIGNS = """SELECT 'camp' || CAST(p_size AS STRING) AS campaign, p_partkey AS product_id, CAST('1997-01-01' AS DATE) AS start_date,
 CASE WHEN p_size % 2 = 0 THEN CAST('1997-12-31' AS DATE) ELSE CAST('1999-06-30' AS DATE) END AS end_date FROM {part}"""


@query("campaign_sales", "J6", f"""
SELECT campaign, ROUND(SUM(amount), 2) AS revenue, COUNT(DISTINCT customer_id) AS customers FROM ({_SALES}) s JOIN ({_CAMPAIGNS}) c ON s.product_id = c.product_id AND sold_on BETWEEN start_date AND end_date GROUP BY 1""")
def campaign_sales(d):
    return lk.campaign_sales(d.sql(_SALES), d.sql(_CAMPAIGNS))


@query("merge_columns", "J11", """
SELECT COALESCE(a.table_full_name, c.table_full_name) AS table_full_name, COALESCE(a.column_name, c.column_name) AS column_name, COALESCE(c.label, a.label) AS label,
 COALESCE(c.classification, a.classification) AS classification, COALESCE(a.description, c.description) AS description, concat_ws(',', a.term_iri, CASE WHEN c.term_iri IS DISTINCT FROM a.term_iri THEN c.term_iri END) AS terms,
 a.asset_type, a.system, CASE WHEN c.column_name IS NULL THEN 'asset' WHEN a.column_name IS NULL THEN 'contract' ELSE 'both' END AS source
FROM {asset_columns} a FULL JOIN {contract_columns} c ON lower(a.table_full_name) = lower(c.table_full_name) AND lower(a.column_name) = lower(c.column_name)""")
def merge_columns(d):
    t = lambda n: d[n].withColumn("terms", F.array("term_iri"))
    return lk.merge_columns(t("asset_columns"), t("contract_columns")).withColumn("terms", F.array_join("terms", ","))


_CINFO = "SELECT 'f' || CAST(o_orderkey AS STRING) AS fqn, name AS contract_name, version AS contract_version, CAST(NULL AS STRING) AS product_name, 't:' || CAST(id % 9 AS STRING) AS link FROM {contracts} JOIN {orders} ON id = o_orderkey WHERE id % 3 <> 0"
_AINFO = "SELECT 'f' || CAST(id AS STRING) AS fqn, CASE WHEN id % 4 = 0 THEN 'asset contract' ELSE NULL END AS contract_name, '9.9.9' AS contract_version, name AS product_name, 't:' || CAST(id % 7 AS STRING) AS link FROM {products} WHERE id % 3 <> 1"


@query("merge_tag_infos", "J12", f"""
SELECT COALESCE(c.fqn, a.fqn) AS fqn, COALESCE(c.contract_name, a.contract_name) AS contract_name, COALESCE(c.contract_version, a.contract_version) AS contract_version,
 COALESCE(c.product_name, a.product_name) AS product_name, concat_ws(',', c.link, CASE WHEN c.link IS DISTINCT FROM a.link THEN a.link END) AS links FROM ({_CINFO}) c FULL JOIN ({_AINFO}) a ON a.fqn = c.fqn""")
def merge_tag_infos(d):
    t = lambda s: d.sql(s).withColumn("links", F.array("link"))
    return lk.merge_tag_infos(t(_CINFO), t(_AINFO), ["contract_name", "contract_version", "product_name"]).withColumn("links", F.array_join("links", ","))


@query("link_schema_to_assets", "J14", """
SELECT object_id, MIN(a.id) AS asset_id FROM {link_objects} o JOIN {assets} a ON a.type IN ('Table', 'View') AND (contains(lower(a.location), lower(o.match_name)) OR a.name = o.match_name) GROUP BY 1""")
def link_schema_to_assets(d):
    return lk.link_schema_to_assets(d["link_objects"], d["assets"])


@query("products_for_contract", "J16", "SELECT id, name FROM {products} WHERE id IN (SELECT product_id FROM {ports} WHERE contract_id IN (SELECT p_partkey FROM part WHERE p_size = 7))")
def products_for_contract(d):
    wanted = d["part"].filter("p_size = 7").select(F.col("p_partkey").alias("contract_id"))
    return lk.products_for_contract(d["ports"], d["products"], wanted).select("id", "name")


@query("contracts_for_product", "J16", "SELECT product_id, contract_id, MIN(port_order) AS first_port FROM {ports} GROUP BY 1, 2")
def contracts_for_product(d):
    return lk.contracts_for_product(d["ports"])


_META = {k: f"SELECT entity_id, item_id, level, created_at, contract_id, inheritable FROM {{metadata_items}} WHERE level % 3 = {i}" for i, k in enumerate(("direct", "attached", "inherited"))}


@query("merged_metadata", "J17", """
SELECT entity_id, item_id, level, created_at, CASE level % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'attached' ELSE 'inherited' END AS origin FROM {metadata_items}
WHERE level % 3 <> 2 OR inheritable QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id, item_id ORDER BY level, created_at) = 1""")
def merged_metadata(d):
    return lk.merged_metadata(d.sql(_META["direct"]), d.sql(_META["attached"]), d.sql(_META["inherited"]))


@query("fan_out", "J18", "SELECT event_id, product_id, subscriber, event_type FROM events e JOIN {subscriptions} s ON s.product_id = e.user_id")
def fan_out(d):
    e = d["events"].select("event_id", F.col("user_id").alias("product_id"), "event_type")
    return lk.fan_out(e, d["subscriptions"])


@query("import_preview", "J19", """
SELECT path, depth, existing_id, CASE WHEN existing_id IS NULL THEN 'create' ELSE 'skip' END AS action FROM (
 SELECT DISTINCT array_to_string(p[1:i], '.') AS path, CAST(i AS INT) AS depth, p[i] AS name FROM (SELECT string_split(location, '.') AS p FROM {assets} WHERE location IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(p))) AS i)) x
LEFT JOIN (SELECT MIN(id) AS existing_id, location FROM {assets} WHERE type = 'Table' AND status = 'active' GROUP BY location) k ON x.path = k.location AND x.depth = 3""")
def import_preview(d):
    levels = F.array(F.lit("Catalog"), F.lit("Schema"), F.lit("Table"))
    paths = ac.expand_ancestors(d["assets"].filter("location IS NOT NULL").select(F.col("location").alias("path")))
    paths = paths.select("path", "depth", F.col("path").alias("location"), F.substring_index("path", ".", -1).alias("name"), F.element_at(levels, F.col("depth")).alias("type"))
    known = d["assets"].filter("type = 'Table' AND status = 'active'").withColumn("name", F.substring_index("location", ".", -1))
    return lk.import_preview(paths, known).select("path", "depth", "existing_id", "action")


_BULK = """
WITH r AS (SELECT *, MIN(row_no) OVER (PARTITION BY lower(COALESCE(name, '')), lower(COALESCE(type, '')), lower(COALESCE(platform, '')), lower(COALESCE(location, ''))) AS first_row FROM {bulk_rows}),
 x AS (SELECT r.*, CASE WHEN trim(COALESCE(name, '')) = '' THEN 'missing name' WHEN trim(COALESCE(type, '')) = '' THEN 'missing type' WHEN lower(type) NOT IN ('table', 'view') THEN 'unknown type'
  WHEN row_no > first_row THEN 'duplicate of row ' || first_row WHEN status <> '' AND lower(status) NOT IN ('draft', 'active', 'deprecated', 'archived') THEN 'invalid status'
  WHEN id IS NOT NULL AND id NOT IN (SELECT id FROM {asset_existing}) THEN 'stale id' END AS reason,
  COALESCE(id, (SELECT MIN(e.id) FROM {asset_existing} e WHERE e.name = trim(r.name) AND lower(e.type) = lower(r.type) AND COALESCE(e.platform, '') = COALESCE(r.platform, ''))) AS target FROM r)
SELECT row_no, CASE WHEN reason IS NOT NULL THEN 'error' WHEN target IS NOT NULL THEN 'update' ELSE 'create' END AS action, reason, CASE WHEN reason IS NULL THEN target END AS existing_id FROM x"""


def _bulk(d):
    types = d.spark.createDataFrame([("Table",), ("View",)], "type_name string")
    return lk.bulk_preview(d["bulk_rows"], types, d["asset_existing"])


@query("bulk_preview", "J20", _BULK)
def bulk_preview(d):
    return _bulk(d)


@query("bulk_preview_counts", "J20", f"SELECT action, COUNT(*) AS n FROM ({_BULK}) GROUP BY action")
def bulk_preview_counts(d):
    return _bulk(d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_rows", "AG31", """
SELECT row_no, first_row FROM (SELECT row_no, MIN(row_no) OVER (PARTITION BY lower(name), lower(COALESCE(type, '')), lower(COALESCE(platform, ''))) AS first_row FROM {bulk_rows}) WHERE row_no > first_row""")
def duplicate_rows(d):
    return lk.duplicate_rows(d["bulk_rows"])


@query("tags_for_entities", "J21", """
SELECT entity_type, entity_id, namespace_name || '/' || tag_name AS tag, assigned_value FROM {tag_assoc} a JOIN {tag_defs} t USING (tag_id) JOIN {tag_namespaces} n USING (namespace_id)
WHERE entity_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def tags_for_entities(d):
    ents = d["orders"].filter("o_orderpriority = '1-URGENT'").select(F.explode(F.array(F.lit("table"), F.lit("data_product"))).alias("entity_type"), F.col("o_orderkey").alias("entity_id"))
    return lk.tags_for_entities(d["tag_assoc"], d["tag_defs"], d["tag_namespaces"], ents)


# ---- tags -------------------------------------------------------------------------------------------------------


@query("scan_tags", "SRC9", "SELECT object_type, full_name, tag_name, MAX(tag_value) AS tag_value FROM {all_tags} GROUP BY 1, 2, 3")
def scan_tags(d):
    return tg.scan_tags(d["catalog_tags"], d["schema_tags"], d["table_tags"])


_CONFIGS = [
    TagConfig("data_domain", "gov.domain", "{DOMAIN}"),
    TagConfig("data_contract", "gov:contract", "{CONTRACT}@{VERSION}"),
    TagConfig("data_product", "gov-product", "{PRODUCT}"),
    TagConfig("semantic_assignment", "gov/{TERM}", "{IRI}"),
    TagConfig("asset", "gov.domain", "asset {TYPE} {PRODUCT}"),
    TagConfig("asset", "never", "x", enabled=False),
]
_DESIRED = """SELECT fqn, tag_key, tag_value FROM (
 SELECT fqn, 0 AS ord, 'gov_domain' AS tag_key, domain_name AS tag_value FROM {tag_infos}
 UNION ALL SELECT fqn, 1, 'gov_contract', contract_name || '@' || contract_version FROM {tag_infos} WHERE contract_name <> '' UNION ALL SELECT fqn, 2, 'gov_product', product_name FROM {tag_infos}
 UNION ALL SELECT fqn, 3, 'gov_' || regexp_replace(split_part(iri, '#', 2), '[^a-z0-9-]', '-', 'g').replace('-', '_'), iri FROM {tag_infos}
 UNION ALL SELECT fqn, 4, 'gov_domain', 'asset ' || asset_type || ' ' || product_name FROM {tag_infos}) WHERE tag_value IS NOT NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY fqn, tag_key ORDER BY ord DESC) = 1"""


def _desired(d):
    from curatrix.functions.scalar import slugify_iri

    infos = d["tag_infos"].withColumn("term", slugify_iri(F.col("iri")))
    names = {"DOMAIN": "domain_name", "CONTRACT": "contract_name", "VERSION": "contract_version", "PRODUCT": "product_name", "TERM": "term", "IRI": "iri", "TYPE": "asset_type"}
    return tg.desired_tags(infos, _CONFIGS, names)


@query("desired_tags", "AG16 SC1 SC2 SC3", _DESIRED)
def desired_tags(d):
    return _desired(d)


@query("parent_tag_values", "AG17", f"""
WITH w AS ({_DESIRED}), u AS (SELECT 'SCHEMA' AS object_type, split_part(fqn, '.', 1) || '.' || split_part(fqn, '.', 2) AS full_name, * FROM w UNION ALL SELECT 'CATALOG', split_part(fqn, '.', 1), * FROM w)
SELECT DISTINCT object_type, full_name, tag_key, tag_value FROM u WHERE tag_value <> ''""")
def parent_tag_values(d):
    return tg.parent_tag_values(_desired(d))


@query("parent_tags", "AG17", f"""
WITH w AS ({_DESIRED}), u AS (SELECT 'SCHEMA' AS object_type, split_part(fqn, '.', 1) || '.' || split_part(fqn, '.', 2) AS full_name, * FROM w UNION ALL SELECT 'CATALOG', split_part(fqn, '.', 1), * FROM w)
SELECT object_type, full_name, tag_key, string_agg(DISTINCT tag_value, ',' ORDER BY tag_value) AS tag_value FROM u GROUP BY 1, 2, 3""")
def parent_tags(d):
    return tg.parent_tags(_desired(d))


@query("reconcile_tags", "U2", """
SELECT COALESCE(o.object_name, n.object_name) AS object_name, COALESCE(o.tag_key, n.tag_key) AS tag_key, CASE WHEN n.object_name IS NULL THEN 'remove' ELSE 'upsert' END AS action, o.tag_value AS old_value, n.tag_value AS new_value
FROM (SELECT * FROM {existing_tags} WHERE tag_key LIKE 'gov\\_%' ESCAPE '\\') o FULL JOIN {wanted_tags} n ON n.object_name = o.object_name AND n.tag_key = o.tag_key
WHERE n.object_name IS NULL OR o.object_name IS NULL OR o.tag_value IS DISTINCT FROM n.tag_value""")
def reconcile_tags(d):
    return tg.reconcile_tags(d["existing_tags"], d["wanted_tags"], "gov_")


_TAGS1 = "(SELECT object_type, full_name, tag_name, MAX(tag_value) AS tag_value FROM {all_tags} GROUP BY 1, 2, 3)"
_INHERIT = f"""SELECT DISTINCT o.object_type, o.full_name FROM {_TAGS1} o WHERE
 (o.object_type, o.full_name) IN (SELECT (object_type, full_name) FROM {_TAGS1} WHERE regexp_matches(tag_value, '(ASIA|_1)'))
 OR (o.object_type = 'TABLE' AND split_part(o.full_name, '.', 1) || '.' || split_part(o.full_name, '.', 2) IN (SELECT full_name FROM {_TAGS1} WHERE object_type = 'SCHEMA' AND regexp_matches(tag_value, '(ASIA|_1)')))
 OR (o.object_type <> 'CATALOG' AND split_part(o.full_name, '.', 1) IN (SELECT full_name FROM {_TAGS1} WHERE object_type = 'CATALOG' AND regexp_matches(tag_value, '(ASIA|_1)')))"""


def _tags(d):
    return tg.scan_tags(d["catalog_tags"], d["schema_tags"], d["table_tags"])


@query("inherit_filter", "F23", _INHERIT)
def inherit_filter(d):
    return tg.inherit_filter(_tags(d), "(ASIA|_1)", "value")


_DISCOVER = f"""
SELECT 'data_product' AS entity_type, regexp_extract(t.tag_value, '([a-z]+[_:][0-9]+)', 1) AS entity, t.object_type, t.full_name FROM {_TAGS1} t JOIN ({_INHERIT}) i USING (object_type, full_name)
WHERE regexp_matches(t.tag_name, 'product$') AND regexp_matches(t.tag_value, '([a-z]+[_:][0-9]+)')
UNION ALL SELECT 'data_contract', regexp_extract(t.tag_value, 'name:(.+)', 1), t.object_type, t.full_name FROM {_TAGS1} t WHERE t.tag_name = 'data-contract' AND regexp_matches(t.tag_value, 'name:(.+)')"""


def _discover(d):
    return tg.discover_entities(_tags(d), [
        DiscoveryPattern("data_product", "product$", "([a-z]+[_:][0-9]+)", filter_regex="(ASIA|_1)", filter_source="value"),
        DiscoveryPattern("data_contract", "^data-contract$", "name:(.+)"),
        DiscoveryPattern("domain", "domain", "(.+)", enabled=False)])


@query("discover_entities", "AG18 F23", _DISCOVER)
def discover_entities(d):
    return _discover(d)


@query("link_products_to_contracts", "J13", """
SELECT DISTINCT 'p' || o_custkey AS product, 'k' || o_custkey % 50 AS contract, 't' || o_orderkey AS full_name FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def link_products_to_contracts(d):
    text = lambda pre, c: F.concat(F.lit(pre), c.cast("string"))
    found = lambda rows, who: rows.select(F.lit("TABLE").alias("object_type"), text("t", F.col("o_orderkey")).alias("full_name"), who.alias("entity"))
    orders = d["orders"]
    return lk.link_products_to_contracts(
        found(orders.filter("o_orderstatus <> 'P'"), text("p", F.col("o_custkey"))), found(orders.filter("o_orderpriority <> '5-LOW'"), text("k", F.col("o_custkey") % 50)))
