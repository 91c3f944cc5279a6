"""Governance frames derived from the given tables.

Each entry is one SELECT that Spark SQL and the oracle both understand, so that a query and its oracle start from
the same rows.  ``{name}`` stands for a base table or another frame.
"""

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FRAMES: dict[str, str] = {}

# ---- compliance -----------------------------------------------------------------------------------------------
FRAMES["entities"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'schema' WHEN o_orderkey % 5 = 1 THEN 'view' WHEN o_orderkey % 5 = 2 THEN 'data_product'
            ELSE 'table' END AS type,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Order ' ELSE 'order_' END || CAST(o_orderkey AS STRING) AS name,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'user' || CAST(o_custkey % 40 AS STRING) END AS owner,
       o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS amount,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'prod' ELSE 'dev' END AS tag_env,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'tier' || CAST(o_orderkey % 4 AS STRING) END AS tag_tier
FROM {orders}"""

FRAMES["policies"] = """
SELECT p_partkey AS id, p_name || ' rule ' || CAST(p_partkey AS STRING) AS name, p_type AS category,
       CASE WHEN p_size % 4 = 0 THEN 'critical' WHEN p_size % 4 = 1 THEN 'high' WHEN p_size % 4 = 2 THEN 'medium' ELSE 'low' END AS severity,
       p_size % 5 <> 0 AS is_active
FROM {part}"""

FRAMES["policy_runs"] = """
SELECT event_id AS id, user_id AS policy_id, ts AS started_at, CASE WHEN value > 100 THEN 100.0 ELSE value END AS score,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status
FROM {events}"""

FRAMES["quality_items"] = """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'data_product' ELSE 'data_contract' END AS entity_type,
       user_id AS entity_id, event_type AS dimension,
       CASE WHEN event_id % 3 = 0 THEN 'manual' WHEN event_id % 3 = 1 THEN 'job' ELSE 'external' END AS source,
       CASE WHEN value > 100 THEN 100.0 ELSE value END AS score_percent, ts AS measured_at
FROM {events}"""

FRAMES["product_contracts"] = """
SELECT DISTINCT user_id AS product_id, user_id + 1 + event_id % 3 AS contract_id FROM {events}"""

# ---- contracts ------------------------------------------------------------------------------------------------
FRAMES["contracts"] = """
SELECT o_orderkey AS id, 'contract_' || CAST(o_custkey AS STRING) || '_' || CAST(o_orderkey AS STRING) AS name,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'contract_' || CAST(o_custkey AS STRING) END AS base_name,
       CAST(1 + o_orderkey % 3 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) || '.0' AS version,
       CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'approved' ELSE 'draft' END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(FLOOR(o_orderkey / 10) AS BIGINT) * 10 END AS parent_contract_id,
       o_custkey % 25 AS domain_id, o_custkey AS owner_team_id, o_orderdate AS created_at
FROM {orders}"""

FRAMES["contract_objects"] = """
SELECT l_orderkey * 16 + l_linenumber AS id, MIN(l_orderkey) AS contract_id,
       'tbl_' || CAST(MIN(l_suppkey) AS STRING) || '_' || CAST(MIN(l_linenumber) AS STRING) AS name,
       CASE WHEN MIN(l_suppkey) % 3 = 0 THEN 'cat.sch.tbl_' WHEN MIN(l_suppkey) % 3 = 1 THEN 'sch.tbl_' ELSE 'tbl_' END
         || CAST(MIN(l_suppkey) AS STRING) AS physical_name
FROM {lineitem} GROUP BY l_orderkey * 16 + l_linenumber"""

FRAMES["contract_properties"] = """
SELECT l_orderkey * 16 + l_linenumber AS object_id, 'col_' || CAST(l_partkey AS STRING) AS name,
       CASE WHEN l_partkey % 4 = 0 THEN 'string' WHEN l_partkey % 4 = 1 THEN 'integer' WHEN l_partkey % 4 = 2 THEN 'double' ELSE 'date' END AS logical_type,
       l_returnflag = 'R' AS required,
       CASE WHEN l_quantity > 40 THEN 'not json' WHEN l_quantity > 20 THEN NULL
            ELSE chr(123) || '"minLength": ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ', "minimum": "' || CAST(l_linenumber AS STRING) || '"' || chr(125) END AS options_json
FROM {lineitem}"""

FRAMES["nested_properties"] = """
SELECT l_orderkey * 16 + l_linenumber AS id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 16 + CAST(FLOOR(l_linenumber / 2) AS BIGINT) END AS parent_id, l_orderkey AS object_id,
       'p' || CAST(MIN(l_partkey) AS STRING) AS name, CASE WHEN MIN(l_partkey) % 3 = 0 THEN 'Array' WHEN MIN(l_partkey) % 3 = 1 THEN 'object' ELSE 'string' END AS logical_type,
       CASE WHEN MIN(l_partkey) % 2 = 0 THEN 'integer' END AS items_logical_type
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

FRAMES["fields_old"] = """
SELECT p_partkey % 200 AS contract_id, p_type AS schema_name, 'f' || CAST(p_partkey AS STRING) AS field_name,
       CASE WHEN p_size % 4 = 0 THEN 'double' WHEN p_size % 4 = 1 THEN 'long' WHEN p_size % 4 = 2 THEN 'timestamp' ELSE 'string' END AS logical_type,
       p_size % 3 = 0 AS required
FROM {part} WHERE p_partkey % 10 <> 3 AND NOT (p_type = 'SMALL' AND p_partkey % 200 < 20)"""

FRAMES["fields_new"] = """
SELECT p_partkey % 200 AS contract_id, p_type AS schema_name, 'f' || CAST(p_partkey AS STRING) AS field_name,
       CASE WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN 'float' WHEN p_size % 4 = 1 AND p_partkey % 3 = 0 THEN 'string'
            WHEN p_size % 4 = 0 THEN 'double' WHEN p_size % 4 = 1 THEN 'long' WHEN p_size % 4 = 2 THEN 'date' ELSE 'string' END AS logical_type,
       (p_size + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) % 3 = 0 AS required
FROM {part} WHERE p_partkey % 10 <> 7 AND NOT (p_type = 'LARGE' AND p_partkey % 200 > 180)"""

FRAMES["rules_old"] = """
SELECT p_partkey % 200 AS contract_id, 'rule_' || CAST(p_partkey AS STRING) AS rule_id FROM {part} WHERE p_size % 9 <> 1"""
FRAMES["rules_new"] = """
SELECT p_partkey % 200 AS contract_id, 'rule_' || CAST(p_partkey AS STRING) AS rule_id FROM {part} WHERE p_size % 9 <> 2"""

# ---- products, ports, access ------------------------------------------------------------------------------------
FRAMES["products"] = """
SELECT o_orderkey AS id, 'product_' || CAST(o_orderkey AS STRING) AS name, o_orderstatus AS status,
       'domain' || CAST(o_custkey % 12 AS STRING) AS domain, 'tenant' || CAST(o_custkey % 3 AS STRING) AS tenant,
       o_orderpriority AS product_type, 'owner' || CAST(o_custkey % 30 AS STRING) AS owner, o_custkey % 50 AS project_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'organization' WHEN o_orderkey % 4 = 1 THEN 'Domain' ELSE 'none' END AS publication_scope,
       CASE WHEN o_orderkey % 3 = 0 THEN 'user' || CAST(o_custkey % 20 AS STRING) ELSE NULL END AS draft_owner,
       o_orderdate AS created_at
FROM {orders}"""

FRAMES["ports"] = """
SELECT l_orderkey AS product_id, l_partkey AS contract_id, l_suppkey AS asset_id, l_linenumber AS port_order,
       'port_' || CAST(l_linenumber AS STRING) AS port_name
FROM {lineitem}"""

FRAMES["grants"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_custkey % 3 = 0 THEN 'data_product' WHEN o_custkey % 3 = 1 THEN 'dataset' ELSE 'data_contract' END AS entity_type,
       o_custkey AS entity_id, 'user' || CAST(o_orderkey % 97 AS STRING) AS grantee,
       CASE WHEN o_orderkey % 6 = 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate + CAST(o_orderkey % 90 AS INT) * INTERVAL '1' DAY END AS expires_at
FROM {orders}"""

FRAMES["access_requests"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_custkey % 3 = 0 THEN 'data_product' WHEN o_custkey % 3 = 1 THEN 'dataset' ELSE 'data_contract' END AS entity_type,
       o_custkey AS entity_id, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'APPROVED' ELSE 'DENIED' END AS status
FROM {orders}"""

FRAMES["grant_config"] = """
SELECT * FROM (VALUES ('data_product', 14), ('dataset', 3)) AS v(entity_type, warning_days)"""

FRAMES["subscriptions"] = """
SELECT DISTINCT user_id AS product_id, 'sub' || CAST(event_id % 40 AS STRING) AS subscriber FROM {events}"""

FRAMES["ratings"] = """
SELECT event_id AS id, user_id AS entity_id, 'u' || CAST(event_id % 7 AS STRING) AS created_by,
       1 + CAST(FLOOR(value) AS BIGINT) % 5 AS rating, ts AS created_at
FROM {events}"""

FRAMES["audit"] = """
SELECT event_id AS id, ts, 'u' || CAST(user_id AS STRING) AS username, event_type AS feature,
       CASE WHEN event_id % 3 = 0 THEN 'CREATE' WHEN event_id % 3 = 1 THEN 'UPDATE' ELSE 'DELETE' END AS action,
       event_type <> 'error' AS success
FROM {events}"""

FRAMES["comments"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 10 END AS project_id,
       CASE WHEN doc_id % 9 = 0 THEN 'deleted' ELSE 'active' END AS status,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN lang WHEN doc_id % 5 = 2 THEN 'team:' || source
            WHEN doc_id % 5 = 3 THEN 'role:' || lang ELSE lang || ',team:' || source END AS audience_csv
FROM {documents}"""

# ---- costs ----------------------------------------------------------------------------------------------------
FRAMES["cost_items"] = """
SELECT l_orderkey * 16 + l_linenumber AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'data_product' ELSE 'dataset' END AS entity_type,
       l_suppkey AS entity_id, CASE l_returnflag WHEN 'A' THEN NULL ELSE 'CC-' || l_returnflag END AS cost_center,
       CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS amount_cents, 'USD' AS currency,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS start_month,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL
            ELSE CAST(date_trunc('month', l_shipdate + l_linenumber * INTERVAL '30' DAY) AS DATE) END AS end_month
FROM {lineitem}"""

FRAMES["usage"] = """
SELECT event_id AS id, ts AS usage_end_time, 'SKU_' || event_type AS sku_name, value AS usage_quantity,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'product_' || CAST(user_id AS STRING) END AS product_tag
FROM {events}"""

FRAMES["prices"] = """
SELECT sku_name, CAST(a AS DATE) AS price_start_time, CAST(b AS DATE) AS price_end_time, CAST(p AS DOUBLE) AS price
FROM (VALUES ('SKU_view', '2023-01-01', '2024-01-10', 0.25), ('SKU_view', '2024-01-10', NULL, 0.3),
             ('SKU_click', '2023-06-01', NULL, 0.125), ('SKU_purchase', '2024-01-15', '2024-01-20', 1.5),
             ('SKU_purchase', '2024-01-20', NULL, 2.0), ('SKU_error', '2024-02-01', NULL, 9.0)) AS v(sku_name, a, b, p)"""

# ---- assets and the column dictionary -----------------------------------------------------------------------------
FRAMES["assets"] = """
SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey % 300 AS STRING) AS name,
       CASE WHEN p_size % 4 = 0 THEN 'Table' WHEN p_size % 4 = 1 THEN 'View' WHEN p_size % 4 = 2 THEN 'Dataset' ELSE 'Column' END AS type,
       CASE WHEN p_size % 2 = 0 THEN 'spark' ELSE NULL END AS platform,
       'domain' || CAST(p_size % 10 AS STRING) AS domain,
       CASE WHEN p_partkey % 9 = 0 THEN 'deprecated' ELSE 'active' END AS status,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'cat' || CAST(p_partkey % 3 AS STRING) || '.' || LOWER(p_type) || '.' || REPLACE(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) END AS location
FROM {part}"""

FRAMES["asset_columns"] = """
SELECT 'Cat' || CAST(l_suppkey % 3 AS STRING) || '.' || CASE WHEN l_suppkey % 2 = 0 THEN 'gold' ELSE 'raw' END || '.T_' || CAST(l_suppkey AS STRING) AS table_full_name,
       'Col_' || CAST(l_partkey AS STRING) AS column_name, MIN(p_name) AS label, MIN(p_type) AS classification,
       CASE WHEN MIN(p_size) % 3 = 0 THEN NULL ELSE MIN(p_name) || ' from asset' END AS description,
       'term:' || MIN(p_brand) AS term_iri, CASE WHEN l_suppkey % 4 = 0 THEN 'View' ELSE 'Table' END AS asset_type,
       CASE WHEN l_suppkey % 5 = 0 THEN 'warehouse' ELSE 'lake' END AS system
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber <> 2 GROUP BY l_suppkey, l_partkey"""

FRAMES["contract_columns"] = """
SELECT 'cat' || CAST(l_suppkey % 3 AS STRING) || '.' || CASE WHEN l_suppkey % 2 = 0 THEN 'gold' ELSE 'raw' END || '.t_' || CAST(l_suppkey AS STRING) AS table_full_name,
       'col_' || CAST(l_partkey AS STRING) AS column_name,
       CASE WHEN MIN(p_size) % 4 = 0 THEN NULL ELSE 'Label ' || MIN(p_name) END AS label, MIN(p_type) || '-C' AS classification,
       MIN(p_name) || ' from contract' AS description, 'term:' || MIN(p_type) AS term_iri
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_linenumber <> 5 GROUP BY l_suppkey, l_partkey"""

# ---- declared and actual schemas, runs, versions --------------------------------------------------------------------
FRAMES["declared_columns"] = """
SELECT p_partkey % 300 AS contract_id, 'Col_' || CAST(p_partkey AS STRING) AS column_name,
       CASE WHEN p_size % 5 = 0 THEN 'decimal' WHEN p_size % 5 = 1 THEN 'bigint' WHEN p_size % 5 = 2 THEN 'string' WHEN p_size % 5 = 3 THEN NULL ELSE 'int' END AS data_type
FROM {part} WHERE p_partkey % 13 <> 5"""
FRAMES["actual_columns"] = """
SELECT p_partkey % 300 AS contract_id, 'col_' || CAST(p_partkey AS STRING) AS column_name,
       CASE WHEN p_size % 5 = 0 THEN 'decimal(10,2)' WHEN p_size % 5 = 1 THEN 'BIGINT' WHEN p_size % 5 = 2 AND p_partkey % 4 = 0 THEN 'double'
            WHEN p_size % 5 = 2 THEN 'string' ELSE 'bigint' END AS data_type
FROM {part} WHERE p_partkey % 17 <> 3"""
FRAMES["lint_columns"] = """
SELECT l_orderkey AS contract_id, 'c' || CAST(l_suppkey % 6 AS STRING) AS column_name, l_returnflag = 'N' AS nullable, l_suppkey % 6 = 0 AS is_pk
FROM {lineitem}"""
FRAMES["lint_contracts"] = """
SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE 'd' END AS domain, CASE WHEN o_orderkey % 30 = 1 THEN NULL ELSE 'o' END AS owner,
       'c' || CAST(o_custkey % 6 AS STRING) AS pk_column, CASE WHEN o_orderkey % 2 = 0 THEN 'c1' ELSE NULL END AS partition_column,
       CASE WHEN o_orderstatus = 'P' THEN 'restricted' ELSE 'internal' END AS classification,
       CASE WHEN o_orderkey % 3 = 0 THEN 'group' ELSE NULL END AS access_control, o_orderdate AS valid_from,
       o_orderdate + CAST(o_orderkey % 40 - 5 AS INT) * INTERVAL '1' DAY AS valid_until
FROM {orders}"""
FRAMES["ports_old"] = """
SELECT p_partkey % 150 AS product_id, CASE WHEN p_size % 3 = 0 THEN 'input' WHEN p_size % 3 = 1 THEN 'output' ELSE 'management' END AS port_type,
       'port' || CAST(p_partkey AS STRING) AS name, 'c' || CAST(p_size AS STRING) AS contract_id, '1.0.0' AS version, p_partkey % 4 = 0 AS required
FROM {part} WHERE p_partkey % 9 <> 1"""
FRAMES["ports_new"] = """
SELECT p_partkey % 150 AS product_id, CASE WHEN p_size % 3 = 0 THEN 'input' WHEN p_size % 3 = 1 THEN 'output' ELSE 'management' END AS port_type,
       'port' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 8 = 0 THEN 'cx' WHEN p_partkey % 8 = 1 THEN NULL ELSE 'c' || CAST(p_size AS STRING) END AS contract_id,
       CASE WHEN p_partkey % 6 = 0 THEN '1.1.0' ELSE '1.0.0' END AS version, p_partkey % 4 = 0 AS required
FROM {part} WHERE p_partkey % 9 <> 2"""
FRAMES["members_old"] = """
SELECT DISTINCT o_custkey AS product_id, 'user' || CAST(o_orderkey % 50 AS STRING) AS member,
       CASE WHEN o_orderkey % 50 < 10 THEN 'Owner' WHEN o_orderkey % 50 < 20 THEN NULL ELSE 'dev' END AS role FROM {orders} WHERE o_orderkey % 50 <> 3"""
FRAMES["members_new"] = """
SELECT DISTINCT o_custkey AS product_id, 'user' || CAST(o_orderkey % 50 AS STRING) AS member,
       CASE WHEN o_orderkey % 50 < 10 THEN 'Owner' ELSE 'dev' END AS role FROM {orders} WHERE o_orderkey % 50 NOT IN (5, 12, 33)"""
FRAMES["support_old"] = """
SELECT DISTINCT o_custkey AS product_id, o_orderpriority AS channel FROM {orders} WHERE o_orderstatus <> 'P'"""
FRAMES["support_new"] = """
SELECT DISTINCT o_custkey AS product_id, o_orderpriority AS channel FROM {orders} WHERE o_orderstatus <> 'O'"""
FRAMES["products_old"] = """
SELECT c_custkey AS product_id, c_name AS name, '1.0.0' AS version, c_mktsegment AS domain, 'draft' AS status,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'p' || CAST(c_nationkey AS STRING) END AS purpose, 'none' AS limitations, c_mktsegment AS usage FROM {customer}"""
FRAMES["products_new"] = """
SELECT c_custkey AS product_id, CASE WHEN c_custkey % 5 = 0 THEN c_name || 'x' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_name END AS name,
       CASE WHEN c_custkey % 3 = 0 THEN '2.0.0' ELSE '1.0.0' END AS version, c_mktsegment AS domain, CAST(NULL AS STRING) AS status,
       'p' || CAST(c_nationkey AS STRING) AS purpose, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'none' END AS limitations, c_mktsegment AS usage FROM {customer}"""

# ---- tags -------------------------------------------------------------------------------------------------------
FRAMES["catalog_tags"] = """
SELECT 'c' || CAST(r_regionkey AS STRING) AS catalog_name, 'domain' AS tag_name, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_name END AS tag_value FROM {region}"""
FRAMES["schema_tags"] = """
SELECT DISTINCT 'c' || CAST(l_suppkey % 5 AS STRING) AS catalog_name, 's' || CAST(l_suppkey AS STRING) AS schema_name,
       CASE WHEN l_suppkey % 7 = 0 THEN 'data-product' ELSE 'team' END AS tag_name, 'prod_' || CAST(l_suppkey % 20 AS STRING) AS tag_value FROM {lineitem}"""
FRAMES["table_tags"] = """
SELECT DISTINCT 'c' || CAST(l_suppkey % 5 AS STRING) AS catalog_name, 's' || CAST(l_suppkey AS STRING) AS schema_name, 't' || CAST(l_partkey AS STRING) AS table_name,
       CASE WHEN l_partkey % 3 = 0 THEN 'data-contract' WHEN l_partkey % 3 = 1 THEN 'data-product' ELSE 'pii' END AS tag_name,
       CASE WHEN l_partkey % 3 = 2 THEN NULL ELSE 'name:' || CAST(l_partkey % 50 AS STRING) END AS tag_value FROM {lineitem}"""
FRAMES["all_tags"] = """
SELECT 'CATALOG' AS object_type, catalog_name AS full_name, tag_name, COALESCE(tag_value, '') AS tag_value FROM {catalog_tags}
UNION ALL SELECT 'SCHEMA', catalog_name || '.' || schema_name, tag_name, COALESCE(tag_value, '') FROM {schema_tags}
UNION ALL SELECT 'TABLE', catalog_name || '.' || schema_name || '.' || table_name, tag_name, COALESCE(tag_value, '') FROM {table_tags}"""
FRAMES["tag_infos"] = """
SELECT 'c' || CAST(l_suppkey % 5 AS STRING) || '.s' || CAST(l_suppkey % 20 AS STRING) || '.t' || CAST(l_partkey AS STRING) AS fqn,
       CASE WHEN MIN(p_size) % 4 = 0 THEN NULL ELSE 'Dom ' || MIN(p_type) END AS domain_name,
       CASE WHEN MIN(p_size) % 3 = 0 THEN '' ELSE 'con-' || CAST(l_partkey % 40 AS STRING) END AS contract_name, '1.0.' || CAST(MIN(p_size) % 3 AS STRING) AS contract_version,
       CASE WHEN MIN(p_size) % 5 = 0 THEN NULL ELSE 'prod ' || MIN(p_brand) END AS product_name, CASE WHEN l_partkey % 2 = 0 THEN 'Table' ELSE 'View' END AS asset_type,
       CASE WHEN MIN(p_size) % 2 = 0 THEN 'http://x.org/terms#' || MIN(p_name) ELSE NULL END AS iri
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey % 5, l_suppkey % 20, l_partkey"""
FRAMES["existing_tags"] = """
SELECT 'c.' || CAST(p_partkey % 400 AS STRING) AS object_name, CASE WHEN p_size % 3 = 0 THEN 'other_' ELSE 'gov_' END || CAST(p_partkey AS STRING) AS tag_key,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS tag_value FROM {part} WHERE p_partkey % 6 <> 1"""
FRAMES["wanted_tags"] = """
SELECT 'c.' || CAST(p_partkey % 400 AS STRING) AS object_name, 'gov_' || CAST(p_partkey AS STRING) AS tag_key,
       CASE WHEN p_partkey % 5 = 0 THEN 'NEW' WHEN p_size % 8 = 0 THEN NULL ELSE p_type END AS tag_value FROM {part} WHERE p_partkey % 6 <> 4"""
FRAMES["tag_assoc"] = """
SELECT l_partkey AS tag_id, CASE WHEN l_suppkey % 2 = 0 THEN 'table' ELSE 'data_product' END AS entity_type, l_orderkey AS entity_id, l_returnflag AS assigned_value FROM {lineitem}"""
FRAMES["tag_defs"] = """SELECT p_partkey AS tag_id, p_size % 5 AS namespace_id, p_name AS tag_name FROM {part}"""
FRAMES["tag_namespaces"] = """SELECT CAST(r_regionkey AS INT) AS namespace_id, LOWER(r_name) AS namespace_name FROM {region}"""

# ---- projects, triggers, links --------------------------------------------------------------------------------------
FRAMES["teams"] = """SELECT s_suppkey AS team_id, CASE WHEN s_nationkey % 6 = 0 THEN NULL ELSE s_nationkey END AS domain_id FROM {supplier}"""
FRAMES["team_members"] = """SELECT DISTINCT l_suppkey AS team_id, 'User' || CAST(l_partkey % 500 AS STRING) AS member FROM {lineitem}"""
FRAMES["projects"] = """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 90 END AS owner_team_id FROM {customer}"""
FRAMES["project_teams"] = """SELECT DISTINCT o_custkey AS project_id, o_orderkey % 100 AS team_id FROM {orders}"""
FRAMES["trigger_events"] = """
SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'on_create' ELSE 'on_status_change' END AS trigger_type,
       CASE WHEN user_id % 3 = 0 THEN 'data_product' ELSE 'data_contract' END AS entity_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'draft' END AS from_status,
       CASE WHEN event_id % 5 = 0 THEN 'active' ELSE 'proposed' END AS to_status FROM {events}"""
FRAMES["workflows"] = """
SELECT * FROM (VALUES (1, 'on_create', 'data_product', CAST(NULL AS STRING), CAST(NULL AS STRING), true), (2, 'on_status_change', 'data_product', 'draft', 'active', true),
 (3, 'on_status_change', 'data_contract', NULL, 'proposed', true), (4, 'on_status_change', 'data_contract', 'active', NULL, true), (5, 'on_create', 'data_contract', NULL, NULL, false))
 AS v(id, trigger_type, entity_type, from_status, to_status, is_active)"""
FRAMES["link_objects"] = """
SELECT s_suppkey AS object_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ring_' || CAST(s_suppkey * 3 AS STRING) WHEN s_suppkey % 3 = 1 THEN 'Red Widget ' || CAST(s_suppkey AS STRING)
       ELSE '_' || CAST(s_suppkey AS STRING) END AS match_name FROM {supplier}"""
FRAMES["metadata_items"] = """
SELECT l_orderkey AS entity_id, l_partkey AS item_id, l_linenumber AS level, l_shipdate AS created_at, l_suppkey AS contract_id, l_returnflag <> 'R' AS inheritable FROM {lineitem}"""
FRAMES["bulk_rows"] = """
SELECT p_partkey AS row_no, CASE WHEN p_partkey % 20 = 0 THEN p_partkey * 2 ELSE NULL END AS id,
       CASE WHEN p_partkey % 50 = 7 THEN ' ' ELSE p_name || ' ' || CAST(p_partkey % 300 AS STRING) END AS name,
       CASE WHEN p_partkey % 40 = 3 THEN NULL WHEN p_size % 9 = 0 THEN 'Gadget' WHEN p_size % 2 = 0 THEN 'Table' ELSE 'view' END AS type,
       CASE WHEN p_size % 2 = 0 THEN 'spark' ELSE NULL END AS platform, CAST(NULL AS STRING) AS location,
       CASE WHEN p_partkey % 33 = 0 THEN 'bogus' WHEN p_partkey % 2 = 0 THEN 'Active' ELSE '' END AS status FROM {part}"""
FRAMES["asset_existing"] = """
SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey % 300 AS STRING) AS name, CASE WHEN p_size % 2 = 0 THEN 'Table' ELSE 'View' END AS type,
       CASE WHEN p_size % 2 = 0 THEN 'spark' ELSE NULL END AS platform, CAST(NULL AS STRING) AS location FROM {part} WHERE p_partkey % 3 = 0"""

# ---- flights ------------------------------------------------------------------------------------------------------
FRAMES["schedule"] = """
SELECT o_orderkey AS flight_key, SUBSTR(o_orderpriority, 1, 1) AS airline_iata, 'N' || CAST(o_custkey % 25 AS STRING) AS dep_iata, 'N' || CAST(o_orderkey % 27 AS STRING) AS arr_iata,
       'T' || CAST(o_custkey AS STRING) AS tail_number, CAST(o_orderdate AS DATE) AS service_date, 100 + o_orderkey % 200 AS seat_capacity,
       o_orderdate + CAST(o_orderkey % 20 AS INT) * INTERVAL '1' HOUR AS scheduled_dep_utc,
       o_orderdate + CAST(o_orderkey % 20 AS INT) * INTERVAL '1' HOUR + CAST(45 + o_orderkey % 600 AS INT) * INTERVAL '1' MINUTE AS scheduled_arr_utc
FROM {orders}"""
FRAMES["flight_status"] = """
SELECT l_orderkey * 16 + l_linenumber AS event_id, l_orderkey AS flight_key,
       CASE WHEN l_suppkey % 10 = 0 THEN 'CANCELLED' WHEN l_suppkey % 10 = 1 THEN 'DIVERTED' WHEN l_returnflag = 'A' THEN 'DEPARTED' ELSE 'ARRIVED' END AS event_type,
       l_shipdate AS event_ts_utc, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 2 - 30 END AS delay_minutes
FROM {lineitem}"""
FRAMES["aircraft"] = """SELECT 'T' || CAST(c_custkey AS STRING) AS tail_number, 40000 + c_acctbal AS mtow_kg, c_mktsegment AS manufacturer, 'M' || CAST(c_custkey % 30 AS STRING) AS model FROM {customer} WHERE c_custkey % 9 <> 0"""
FRAMES["airports"] = """
SELECT 'N' || CAST(n_nationkey AS STRING) AS iata, n_name AS name, 'City ' || CAST(n_nationkey AS STRING) AS city, r_name AS country_iso,
       CAST(n_nationkey * 6 - 70 AS DOUBLE) AS lat, CAST((n_nationkey * 47) % 360 - 180 AS DOUBLE) AS lon FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
FRAMES["legs"] = """
SELECT flight_key, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM {schedule} s JOIN {airports} a ON s.dep_iata = a.iata JOIN {airports} b ON s.arr_iata = b.iata"""
FRAMES["duty_logs"] = """
SELECT l_orderkey * 16 + l_linenumber AS log_id, CAST(l_shipdate AS DATE) AS log_date, l_quantity / 3.5 AS flight_duty_period_hours, l_quantity / 3.5 > 12 AS exceeded FROM {lineitem}"""

# ---- sales ----------------------------------------------------------------------------------------------------------
FRAMES["s_orders"] = "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_totalprice AS total_amount FROM {orders}"
FRAMES["s_customers"] = """
SELECT c_custkey AS customer_id, c_mktsegment AS customer_segment, c_nationkey AS country_code, CAST('1994-01-01' AS DATE) + CAST(c_custkey % 300 AS INT) AS created_at,
       CASE WHEN c_acctbal > 8000 THEN 'PLATINUM' WHEN c_acctbal > 5000 THEN 'GOLD' WHEN c_acctbal > 2000 THEN 'SILVER' ELSE 'BRONZE' END AS loyalty_tier FROM {customer}"""
FRAMES["s_countries"] = "SELECT n_nationkey AS country_code, n_name AS country_name, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
FRAMES["s_products"] = "SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category_name, p_retailprice AS list_price, p_retailprice * 0.01 * (30 + p_size) AS cost_price FROM {part}"
FRAMES["s_items"] = "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice AS line_total, l_extendedprice / l_quantity AS unit_price FROM {lineitem}"

# ---- search ---------------------------------------------------------------------------------------------------------
FRAMES["search_items"] = """
SELECT p_partkey AS id, p_type AS type, p_name || ' ' || CAST(p_partkey AS STRING) AS title, CASE WHEN p_size % 4 = 0 THEN NULL ELSE LOWER(p_brand) || '/' || LOWER(p_type) || ' ' || p_name END AS tags,
       CASE WHEN p_size % 3 = 0 THEN 'all about the ' || p_name ELSE p_brand END AS description FROM {part}"""

# ---- knowledge graph --------------------------------------------------------------------------------------------------
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_SKOS = "http://www.w3.org/2004/02/skos/core#"
_OWL = "http://www.w3.org/2002/07/owl#"
_PART = "'http://x.org/part/' || CAST(p_partkey AS STRING)"
_UP = "'http://x.org/part/' || CAST(CAST(FLOOR(p_partkey / 3) AS BIGINT) AS STRING)"
_CTX = "'urn:glossary:c' || CAST(p_partkey % 30 AS STRING)"
_BN = "'urn:gov:bnode:e' || CAST(p_partkey AS STRING)"


def _triple(source: str, subject: str, predicate: str, obj: str, uri: bool, context: str, where: str = "", lang: str = "CAST(NULL AS STRING)", dtype: str = "CAST(NULL AS STRING)") -> str:
    cond = f" WHERE {where}" if where else ""
    return (f"SELECT {subject} AS subject, {predicate} AS predicate, {obj} AS object, {'true' if uri else 'false'} AS object_is_uri, {lang} AS language, "
            f"{dtype} AS datatype, {context} AS context FROM {{{source}}}{cond}")


def _u(iri: str) -> str:
    return f"'{iri}'"


_KIND = (f"CASE p_size % 6 WHEN 0 THEN '{_OWL}Class' WHEN 1 THEN '{_SKOS}Concept' WHEN 2 THEN '{_RDF}Property' WHEN 3 THEN '{_OWL}NamedIndividual' "
         f"WHEN 4 THEN 'http://x.org/part/0' ELSE '{_OWL}ObjectProperty' END")
_EDGE = f"CASE p_size % 6 WHEN 1 THEN '{_SKOS}broader' WHEN 2 THEN '{_RDFS}subPropertyOf' WHEN 5 THEN '{_RDFS}subPropertyOf' ELSE '{_RDFS}subClassOf' END"
_COLL_IRI = "'urn:glossary:c' || CAST(c_custkey AS STRING)"

FRAMES["triples"] = "\nUNION ALL ".join([
    _triple("part", _PART, _u(_RDF + "type"), _KIND, True, _CTX),
    _triple("part", _PART, _EDGE, _UP, True, _CTX, "p_partkey > 0"),
    _triple("part", _PART, _u(_RDFS + "label"), "p_name || ' ' || CAST(p_partkey AS STRING)", False, _CTX, "p_partkey % 7 <> 0", "CASE WHEN p_partkey % 4 = 0 THEN 'en' WHEN p_partkey % 4 = 1 THEN 'de' ELSE CAST(NULL AS STRING) END"),
    _triple("part", _PART, _u(_SKOS + "prefLabel"), "'preferred ' || p_name", False, _CTX, "p_partkey % 5 = 0", "'en'"),
    _triple("part", _PART, _u(_RDFS + "comment"), "'made by ' || p_brand", False, _CTX, "p_partkey % 3 = 0"),
    _triple("part", _PART, _u(_SKOS + "definition"), "'a ' || p_type", False, _CTX, "p_partkey % 6 = 0", "'en'"),
    _triple("part", _PART, _u(_SKOS + "related"), "'http://x.org/part/' || CAST(p_size AS STRING)", True, _CTX, "p_size % 6 = 1"),
    _triple("part", _PART, _u(_RDFS + "domain"), "'http://x.org/part/' || CAST(p_size AS STRING)", True, _CTX, "p_size % 6 = 5"),
    _triple("part", _PART, _u(_RDFS + "range"), "'http://x.org/type/' || p_type", True, _CTX, "p_size % 6 = 5 AND p_partkey % 4 <> 1"),
    _triple("part", _PART, _u("urn:gov:isHierarchical"), "CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END", False, _CTX, "p_size % 6 = 5"),
    _triple("part", _PART, _u("urn:gov:uiLabel"), "'UI ' || p_name", False, _CTX, "p_size % 6 = 5 AND p_partkey % 3 = 0"),
    _triple("part", _PART, _u(_RDF + "type"), _u(_OWL + "FunctionalProperty"), True, _CTX, "p_size % 6 = 5 AND p_partkey % 5 = 0"),
    _triple("part", _PART, _u("urn:gov:status"), "CASE WHEN p_partkey % 2 = 0 THEN 'draft' ELSE 'active' END", False, _CTX, "p_partkey % 3 = 1"),
    _triple("part", _PART, _u("urn:gov:price"), "CAST(p_size AS STRING)", False, _CTX, "p_partkey % 4 <> 2", dtype="'http://www.w3.org/2001/XMLSchema#integer'"),
    # A equivalentClass [ intersectionOf ( B C ) ]
    _triple("part", _PART, _u(_OWL + "equivalentClass"), _BN, True, _CTX, "p_partkey % 20 = 0"),
    _triple("part", _BN, _u(_OWL + "intersectionOf"), f"{_BN} || 'l1'", True, _CTX, "p_partkey % 20 = 0"),
    _triple("part", f"{_BN} || 'l1'", _u(_RDF + "first"), "'http://x.org/type/' || p_type", True, _CTX, "p_partkey % 20 = 0"),
    _triple("part", f"{_BN} || 'l1'", _u(_RDF + "rest"), f"{_BN} || 'l2'", True, _CTX, "p_partkey % 20 = 0"),
    _triple("part", f"{_BN} || 'l2'", _u(_RDF + "first"), "'http://x.org/brand/' || p_brand", True, _CTX, "p_partkey % 20 = 0"),
    _triple("part", f"{_BN} || 'l2'", _u(_RDF + "rest"), f"CASE WHEN p_partkey % 40 = 0 THEN '{_RDF}nil' ELSE {_BN} || 'l1' END", True, _CTX, "p_partkey % 20 = 0"),
    # restrictions
    _triple("part", _PART, _u(_RDFS + "subClassOf"), f"{_BN} || 'r'", True, _CTX, "p_size % 6 = 0"),
    _triple("part", f"{_BN} || 'r'", _u(_RDF + "type"), _u(_OWL + "Restriction"), True, _CTX, "p_size % 6 = 0"),
    _triple("part", f"{_BN} || 'r'", _u(_OWL + "onProperty"), "'http://x.org/prop/' || p_type", True, _CTX, "p_size % 6 = 0"),
    _triple("part", f"{_BN} || 'r'", _u(_OWL + "minCardinality"), "CAST(p_size AS STRING)", False, _CTX, "p_size % 6 = 0 AND p_partkey % 2 = 0"),
    _triple("part", f"{_BN} || 'r'", _u(_OWL + "someValuesFrom"), "'http://x.org/type/' || p_type", True, _CTX, "p_size % 6 = 0 AND p_partkey % 2 = 1"),
    # governed entities typed with concepts, in a graph of their own
    _triple("supplier", "'urn:gov:data_product:' || CAST(s_suppkey AS STRING)", _u(_RDF + "type"), "'http://x.org/part/' || CAST(s_suppkey % 7 AS STRING)", True, "'urn:app-entities'"),
    _triple("supplier", "'urn:gov:data_product:' || CAST(s_suppkey AS STRING)", _u(_RDFS + "label"), "s_name", False, "'urn:app-entities'", "s_suppkey % 3 <> 0"),
    # collections
    _triple("customer", _COLL_IRI, _u(_RDF + "type"), _u("urn:gov:KnowledgeCollection"), True, "'urn:meta:sources'"),
    _triple("customer", _COLL_IRI, _u(_RDFS + "label"), "c_name", False, "'urn:meta:sources'", "c_custkey % 6 <> 0"),
    _triple("customer", _COLL_IRI, _u("urn:gov:scopeLevel"), "CASE WHEN c_custkey % 3 = 0 THEN 'domain' ELSE 'team' END", False, "'urn:meta:sources'", "c_custkey % 4 <> 0"),
    _triple("customer", _COLL_IRI, _u("urn:gov:parentCollection"), "'urn:glossary:c' || CAST(CAST(FLOOR(c_custkey / 4) AS BIGINT) AS STRING)", True, "'urn:meta:sources'", "c_custkey > 3"),
    _triple("customer", _COLL_IRI, _u("urn:gov:isEditable"), "CASE WHEN c_custkey % 5 = 0 THEN 'false' ELSE 'true' END", False, "'urn:meta:sources'"),
])

FRAMES["semantic_links"] = """
SELECT DISTINCT 'data_contract' AS entity_type, l_orderkey AS entity_id, 'http://x.org/part/' || CAST(l_partkey AS STRING) AS iri FROM {lineitem}"""

# ---- relationships and lineage ------------------------------------------------------------------------------------------
FRAMES["relations"] = """
SELECT 'data_product' AS source_type, l_orderkey AS source_id, 'hasDataset' AS relationship_type, 'dataset' AS target_type, l_partkey AS target_id FROM {lineitem}
UNION ALL SELECT 'dataset', p_partkey, 'hasTable', 'table', p_partkey % 100 FROM {part} WHERE p_size % 5 <> 0
UNION ALL SELECT 'table', s_suppkey, 'hasColumn', 'column', s_suppkey * 10 FROM {supplier} UNION ALL SELECT 'table', s_suppkey, 'hasColumn', 'column', s_suppkey * 10 + 1 FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'dataset', p_partkey, 'governedBy', 'data_contract', p_partkey % 70 FROM {part} WHERE p_size % 4 = 0
UNION ALL SELECT 'table', s_suppkey, 'belongsToSystem', 'system', s_nationkey FROM {supplier}"""
FRAMES["relation_edges"] = """
SELECT DISTINCT source_type || ':' || CAST(source_id AS STRING) AS src, target_type || ':' || CAST(target_id AS STRING) AS dst, relationship_type FROM {relations}"""
FRAMES["legacy_relations"] = """
SELECT * FROM {relations} WHERE source_id % 4 = 0 UNION ALL SELECT 'dataset', p_partkey, 'supersedes', 'dataset', p_partkey + 1 FROM {part} WHERE p_size = 9"""
FRAMES["lineage"] = """
SELECT 't' || CAST(CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS STRING) AS src, 't' || CAST(o_orderkey AS STRING) AS dst, 'feeds' AS relationship_type,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'c' || CAST(o_orderkey % 4 AS STRING) END AS map_from, 'c' || CAST(o_orderkey % 5 AS STRING) AS map_to FROM {orders} WHERE o_orderkey > 0
UNION ALL SELECT 't' || CAST(o_orderkey AS STRING), 't' || CAST(CAST(FLOOR(o_orderkey / 16) AS BIGINT) AS STRING), 'refreshes', 'c1', 'c2' FROM {orders} WHERE o_orderkey % 101 = 0 AND o_orderkey > 16"""
FRAMES["lineage_nodes"] = """
SELECT 't' || CAST(o_orderkey AS STRING) AS node, CASE o_orderkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'external' ELSE 'table' END AS kind,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'owner' || CAST(o_custkey % 20 AS STRING) END AS owner,
       CASE WHEN o_orderkey % 37 = 1 THEN CAST(1 + o_custkey % 3 AS INT) ELSE NULL END AS level FROM {orders}"""
FRAMES["asset_refs"] = """
SELECT o_orderkey AS node, CASE WHEN o_orderkey % 97 = 5 THEN o_orderkey + 97 WHEN o_orderkey % 97 = 6 AND o_orderkey > 97 THEN o_orderkey - 1
       WHEN o_orderkey < 10 THEN NULL WHEN o_orderkey % 1000 = 999 THEN o_orderkey ELSE CAST(FLOOR(o_orderkey / 4) AS BIGINT) END AS parent FROM {orders}
UNION ALL SELECT o_orderkey, o_orderkey * 4 + 1 FROM {orders} WHERE o_orderkey % 31 = 3 UNION ALL SELECT o_orderkey, o_orderkey + 4 FROM {orders} WHERE o_orderkey % 41 = 2"""

# ---- record matching ------------------------------------------------------------------------------------------------------
FRAMES["mdm_master"] = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'Shared Desk' ELSE c_name END AS customer_name,
       CASE WHEN c_custkey % 50 = 0 THEN 'desk@x.org' WHEN c_custkey % 23 = 0 THEN NULL ELSE LOWER(c_mktsegment) || CAST(c_custkey AS STRING) || '@x.org' END AS email,
       CASE WHEN c_custkey % 50 = 0 THEN '555-0000' ELSE '+1-555-' || CAST(1000000 + c_custkey * 7 AS STRING) END AS phone, c_mktsegment AS segment FROM {customer}"""
FRAMES["mdm_source"] = """
SELECT c_custkey + 5000000 AS id,
       CASE WHEN c_custkey % 50 = 0 THEN 'Shared Desk' WHEN c_custkey % 5 = 1 THEN REPLACE(c_name, 'Customer', 'Custmer') WHEN c_custkey % 5 = 2 THEN UPPER(c_name) ELSE c_name END AS customer_name,
       CASE WHEN c_custkey % 50 = 0 THEN ' DESK@x.org' WHEN c_custkey % 5 = 3 THEN 'new' || CAST(c_custkey AS STRING) || '@y.org' ELSE ' ' || UPPER(c_mktsegment) || CAST(c_custkey AS STRING) || '@X.org ' END AS email,
       CASE WHEN c_custkey % 50 = 0 THEN '5550000' WHEN c_custkey % 7 = 3 THEN '(555) ' || CAST(2000000 + c_custkey * 7 AS STRING) ELSE '555 ' || CAST(1000000 + c_custkey * 7 AS STRING) END AS phone,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM {customer}"""
FRAMES["merge_candidates"] = """
SELECT s.id AS source_id, CASE WHEN s.id % 9 = 0 THEN NULL ELSE m.id END AS master_id, CASE WHEN s.id % 4 = 0 THEN 0.96 ELSE 0.85 END AS confidence,
       CASE WHEN s.id % 3 = 0 THEN 'approved' WHEN s.id % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status,
       CASE WHEN s.id % 9 = 0 THEN NULL ELSE m.customer_name END AS m_customer_name, CASE WHEN s.id % 9 = 0 THEN NULL ELSE m.email END AS m_email, CASE WHEN s.id % 9 = 0 THEN NULL ELSE m.phone END AS m_phone,
       CASE WHEN s.id % 9 = 0 THEN NULL ELSE m.segment END AS m_segment, CASE WHEN s.id % 11 = 0 THEN '' ELSE s.customer_name END AS s_customer_name, s.email AS s_email, s.phone AS s_phone, s.segment AS s_segment,
       CASE WHEN s.id % 15 = 0 THEN 'given' ELSE NULL END AS given_segment, CASE WHEN s.id % 5 = 0 THEN NULL ELSE s.id END AS review_id
FROM {mdm_source} s JOIN {mdm_master} m ON m.id = s.id - 5000000"""
FRAMES["mdm_values"] = """
SELECT id AS k, 'crm' AS source, 2 AS priority, email AS value FROM {mdm_master} UNION ALL SELECT id - 5000000, 'erp', 1, CASE WHEN id % 6 = 0 THEN '' ELSE email END FROM {mdm_source}"""
