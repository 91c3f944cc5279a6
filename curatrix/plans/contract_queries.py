"""Registered queries: contract validation, profiling and version comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from curatrix.operators import contracts as ct
from curatrix.operators import profiling as pf
from curatrix.plans.registry import query

AS_OF = datetime(2024, 1, 31)

DRIFT = """SELECT COALESCE(d.contract_id, a.contract_id) AS contract_id, COALESCE(lower(d.column_name), lower(a.column_name)) AS column_name,
 lower(d.data_type) AS declared_type, lower(a.data_type) AS actual_type,
 CASE WHEN a.column_name IS NULL THEN 'missing' WHEN d.column_name IS NULL THEN 'extra'
  WHEN COALESCE(contains(lower(a.data_type), lower(d.data_type)) OR contains(lower(d.data_type), lower(a.data_type)), true) THEN 'ok' ELSE 'type_mismatch' END AS drift
FROM {declared_columns} d FULL JOIN {actual_columns} a ON d.contract_id = a.contract_id AND lower(d.column_name) = lower(a.column_name)"""


def _drift(d):
    return ct.schema_drift(d["actual_columns"], d["declared_columns"], ["contract_id"])


@query("schema_drift", "DQ17 U6", DRIFT)
def schema_drift(d):
    return _drift(d)


@query("declared_paths", "DQ17 SRC2", """
SELECT object_id, column_name, data_type FROM (WITH RECURSIVE t AS (
 SELECT id, object_id, name AS path, logical_type, items_logical_type FROM {nested_properties} p WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM {nested_properties} a WHERE a.id = p.parent_id)
 UNION ALL SELECT p.id, p.object_id, t.path || CASE WHEN t.logical_type = 'Array' THEN '[].' ELSE '.' END || p.name, p.logical_type, p.items_logical_type FROM {nested_properties} p JOIN t ON p.parent_id = t.id)
 SELECT object_id, path AS column_name, logical_type AS data_type FROM t UNION ALL SELECT object_id, path || '[]', items_logical_type FROM t WHERE logical_type = 'Array' AND items_logical_type IS NOT NULL)""")
def declared_paths(d):
    """Paths and types that properties below properties declare, items of arrays included."""
    return ct.declared_paths(d["nested_properties"])


DRIFT_RESULT = f"""SELECT contract_id, COUNT(*) FILTER (drift = 'missing') AS missing_columns, COUNT(*) FILTER (drift = 'extra') AS extra_columns,
 COUNT(*) FILTER (drift = 'type_mismatch') AS type_mismatches, COUNT(*) FILTER (drift IN ('missing', 'type_mismatch')) = 0 AS passed
FROM ({DRIFT}) GROUP BY contract_id"""


@query("schema_drift_result", "DQ17", DRIFT_RESULT)
def schema_drift_result(d):
    return ct.drift_result(_drift(d), ["contract_id"])


FRESH = """SELECT user_id, MAX(ts) AS last_modified, ROUND(date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-01-31') / 3600.0, 4) AS age_hours,
 date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-01-31') / 3600.0 <= 36 AS passed FROM events GROUP BY user_id"""


def _fresh(d):
    last = d["events"].groupBy("user_id").agg(F.max("ts").alias("m")).select("user_id", F.col("m").alias("last_modified"), F.date_trunc("second", "m").alias("s"))
    return ct.table_freshness(last, AS_OF, 36, ts="s").drop("s")


@query("table_freshness", "DQ18 DQ14", FRESH)
def table_freshness(d):
    return _fresh(d)


DQ_STATUS = """SELECT c.p_partkey AS policy_id, r.status, r.score, COALESCE(r.status = 'succeeded' AND r.score >= 20, false) AS passed
FROM (SELECT p_partkey FROM part) c LEFT JOIN (SELECT * FROM {policy_runs} QUALIFY ROW_NUMBER() OVER (PARTITION BY policy_id ORDER BY started_at DESC, id DESC) = 1) r
 ON r.policy_id = c.p_partkey"""


def _dq_status(d):
    return ct.dq_status(d["policy_runs"], d["part"].select(F.col("p_partkey").alias("policy_id")), "policy_id", 20.0)


@query("dq_status", "DQ19 J9", DQ_STATUS)
def dq_status(d):
    return _dq_status(d)


@query("validate_contracts", "DQ20", f"""
SELECT contract_id, COUNT(*) FILTER (passed) AS checks_passed, COUNT(*) FILTER (NOT passed) AS checks_failed,
 ROUND(100.0 * COUNT(*) FILTER (passed) / COUNT(*), 2)::DOUBLE AS score FROM (
 SELECT contract_id, passed FROM ({DRIFT_RESULT}) UNION ALL SELECT user_id, passed FROM ({FRESH}) UNION ALL SELECT policy_id, passed FROM ({DQ_STATUS}))
GROUP BY contract_id""")
def validate_contracts(d):
    drift = ct.drift_result(_drift(d), ["contract_id"])
    fresh = _fresh(d).withColumnRenamed("user_id", "contract_id")
    status = _dq_status(d).withColumnRenamed("policy_id", "contract_id")
    return ct.validate_contracts("contract_id", drift, fresh, status)


@query("structural_lint", "DQ21", """
SELECT contract_id, 'duplicate_column' AS finding, column_name AS detail FROM {lint_columns} GROUP BY contract_id, column_name HAVING COUNT(*) > 1
UNION ALL SELECT DISTINCT contract_id, 'nullable_primary_key', column_name FROM {lint_columns} WHERE nullable AND is_pk
UNION ALL SELECT contract_id, 'missing_primary_key', pk_column FROM {lint_contracts} c WHERE NOT EXISTS (SELECT 1 FROM {lint_columns} l WHERE l.contract_id = c.contract_id AND l.column_name = c.pk_column)
UNION ALL SELECT contract_id, 'missing_partition_column', partition_column FROM {lint_contracts} c WHERE partition_column IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM {lint_columns} l WHERE l.contract_id = c.contract_id AND l.column_name = c.partition_column)
UNION ALL SELECT contract_id, 'domain_required', NULL FROM {lint_contracts} WHERE domain = ''
UNION ALL SELECT contract_id, 'owner_required', NULL FROM {lint_contracts} WHERE owner IS NULL
UNION ALL SELECT contract_id, 'restricted_without_access_control', NULL FROM {lint_contracts} WHERE classification = 'restricted' AND access_control IS NULL
UNION ALL SELECT contract_id, 'ends_before_start', NULL FROM {lint_contracts} WHERE valid_until < valid_from""")
def structural_lint(d):
    return ct.structural_lint(d["lint_columns"], d["lint_contracts"], "contract_id")


_PROFILE_COLS = ["project_id", "status", "audience_csv", "id"]
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, "
    f"ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2)::DOUBLE AS null_pct FROM {{comments}}" for c in _PROFILE_COLS)


@query("profile_columns", "DQ22", _PROFILE)
def profile_columns(d):
    return pf.profile_columns(d["comments"], _PROFILE_COLS, exact=True)


_DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("profile_documents", "DQ22", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2)::DOUBLE AS null_pct FROM documents" for c in _DOC_COLS))
def profile_documents(d):
    return pf.profile_columns(d["documents"], _DOC_COLS, exact=True)


_TOP_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("top_values", "W8 DQ22", "SELECT column_name, value, n, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INT) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM orders GROUP BY {c}" for c in _TOP_COLS) + ")) WHERE rank <= 3")
def top_values(d):
    return pf.frequent_values(d["orders"], _TOP_COLS)


_SUPPLIER = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def _suggested(table, cols, numeric):
    return "SELECT column_name, rule_function, arguments, 'pending' AS status FROM (" + " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, 'is_not_null' AS rule_function, CAST(NULL AS VARCHAR) AS arguments FROM {table} HAVING COUNT({c}) = COUNT(*)" for c in cols]
        + [f"SELECT '{c}', 'is_unique', NULL FROM {table} HAVING COUNT(DISTINCT {c}) = COUNT(*)" for c in cols]
        + [f"SELECT '{c}', 'is_in', string_agg(DISTINCT CAST({c} AS VARCHAR), ',' ORDER BY CAST({c} AS VARCHAR)) FROM {table} HAVING COUNT(DISTINCT {c}) BETWEEN 1 AND 20" for c in cols]
        + [f"SELECT '{c}', 'min_max', CAST(MIN({c})::DOUBLE AS VARCHAR) || ',' || CAST(MAX({c})::DOUBLE AS VARCHAR) FROM {table}" for c in numeric]) + ")"


@query("suggest_rules", "DQ23", _suggested("supplier", _SUPPLIER, [c for c in _SUPPLIER if c != "s_name"]))
def suggest_rules(d):
    return pf.suggest_rules(d["supplier"])


_SUGGEST = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("suggest_rules_orders", "DQ23", _suggested("orders", _SUGGEST, _SUGGEST[:2]))
def suggest_rules_orders(d):
    return pf.suggest_rules(d["orders"].select(*_SUGGEST))


@query("suggestion_counts", "DQ24", """
SELECT user_id AS run_id, COUNT(*) FILTER (event_type IN ('view', 'click')) AS pending, COUNT(*) FILTER (event_type = 'purchase') AS accepted,
 COUNT(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY user_id""")
def suggestion_counts(d):
    status = F.when(F.col("event_type").isin("view", "click"), "pending").when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected")
    return pf.suggestion_counts(d["events"].select(F.col("user_id").alias("run_id"), status.alias("status")))


FIELD_DIFF = """
SELECT COALESCE(o.contract_id, n.contract_id) AS contract_id, COALESCE(o.schema_name, n.schema_name) AS schema_name, NULL AS field_name,
 CASE WHEN n.contract_id IS NULL THEN 'removed' ELSE 'added' END AS change_type, CASE WHEN n.contract_id IS NULL THEN 'breaking' ELSE 'feature' END AS impact,
 NULL AS old_value, NULL AS new_value
FROM (SELECT DISTINCT contract_id, schema_name FROM {fields_old}) o FULL JOIN (SELECT DISTINCT contract_id, schema_name FROM {fields_new}) n USING (contract_id, schema_name)
WHERE o.contract_id IS NULL OR n.contract_id IS NULL
UNION ALL SELECT contract_id, schema_name, field_name, u.change_type, u.impact, u.old_value, u.new_value FROM (
 SELECT contract_id, schema_name, field_name, unnest([
  {'change_type': CASE WHEN n.required IS NULL THEN 'removed' END, 'impact': CASE WHEN o.required THEN 'breaking' ELSE 'fix' END, 'old_value': NULL::VARCHAR, 'new_value': NULL::VARCHAR},
  {'change_type': CASE WHEN o.required IS NULL THEN 'added' END, 'impact': CASE WHEN n.required THEN 'breaking' ELSE 'feature' END, 'old_value': NULL, 'new_value': NULL},
  {'change_type': CASE WHEN o.logical_type <> n.logical_type THEN 'type_changed' END,
   'impact': CASE WHEN o.logical_type || n.logical_type IN ('doublefloat', 'longint', 'timestampdate') THEN 'fix' ELSE 'breaking' END, 'old_value': o.logical_type, 'new_value': n.logical_type},
  {'change_type': CASE WHEN o.required <> n.required THEN 'modified' END, 'impact': CASE WHEN n.required THEN 'breaking' ELSE 'fix' END,
   'old_value': 'required=' || CAST(o.required AS VARCHAR), 'new_value': 'required=' || CAST(n.required AS VARCHAR)}]) AS u
 FROM {fields_old} o FULL JOIN {fields_new} n USING (contract_id, schema_name, field_name)
 WHERE (contract_id, schema_name) IN (SELECT (contract_id, schema_name) FROM {fields_old}) AND (contract_id, schema_name) IN (SELECT (contract_id, schema_name) FROM {fields_new}))
WHERE u.change_type IS NOT NULL"""


@query("diff_contract_fields", "U3", FIELD_DIFF)
def diff_contract_fields(d):
    return ct.diff_fields(d["fields_old"], d["fields_new"], "contract_id")


RULE_DIFF = """SELECT contract_id, rule_id, 'removed' AS change_type, 'fix' AS impact FROM ((SELECT * FROM {rules_old}) EXCEPT (SELECT * FROM {rules_new}))
UNION ALL SELECT contract_id, rule_id, 'added', 'breaking' FROM ((SELECT * FROM {rules_new}) EXCEPT (SELECT * FROM {rules_old}))"""


@query("diff_contract_rules", "U3", RULE_DIFF)
def diff_contract_rules(d):
    return ct.diff_rules(d["rules_old"], d["rules_new"], "contract_id")


@query("version_bump", "U5 SC14", f"""
SELECT contract_id, version, bump AS version_bump, CASE bump WHEN 'major' THEN CAST(maj + 1 AS VARCHAR) || '.0.0' WHEN 'minor' THEN CAST(maj AS VARCHAR) || '.' || CAST(mnr + 1 AS VARCHAR) || '.0'
 WHEN 'patch' THEN CAST(maj AS VARCHAR) || '.' || CAST(mnr AS VARCHAR) || '.1' ELSE version END AS next_version FROM (
 SELECT v.*, CASE r WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'patch' ELSE 'none' END AS bump FROM (
  SELECT p_partkey AS contract_id, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.0' AS version, p_size AS maj, p_partkey % 7 AS mnr FROM part) v
 LEFT JOIN (SELECT contract_id, MAX(CASE impact WHEN 'breaking' THEN 3 WHEN 'feature' THEN 2 ELSE 1 END) AS r FROM ({FIELD_DIFF}) WHERE change_type = 'added' OR contract_id % 3 = 0 GROUP BY 1) c USING (contract_id))""")
def version_bump(d):
    changes = ct.diff_fields(d["fields_old"], d["fields_new"], "contract_id").filter("change_type = 'added' OR contract_id % 3 = 0")
    versions = d["part"].select(F.col("p_partkey").alias("contract_id"), F.concat_ws(".", "p_size", F.col("p_partkey") % 7, F.lit("0")).alias("version"))
    return ct.version_bump(changes, versions, "contract_id")


PORT_DIFF = """SELECT product_id, port_type, name, u.change_type, u.impact, u.old_value, u.new_value FROM (
 SELECT product_id, port_type, name, unnest([
  {'change_type': CASE WHEN n.required IS NULL THEN 'removed' END, 'impact': CASE WHEN port_type = 'output' OR (port_type = 'input' AND o.required) THEN 'breaking' ELSE 'fix' END, 'old_value': NULL::VARCHAR, 'new_value': NULL::VARCHAR},
  {'change_type': CASE WHEN o.required IS NULL THEN 'added' END, 'impact': CASE WHEN port_type = 'input' AND n.required THEN 'breaking' ELSE 'feature' END, 'old_value': NULL, 'new_value': NULL},
  {'change_type': CASE WHEN o.contract_id <> n.contract_id THEN 'contract_changed' END, 'impact': CASE WHEN port_type = 'output' THEN 'breaking' ELSE 'fix' END, 'old_value': o.contract_id, 'new_value': n.contract_id},
  {'change_type': CASE WHEN o.version <> n.version THEN 'version_changed' END, 'impact': 'fix', 'old_value': o.version, 'new_value': n.version}]) AS u
 FROM {ports_old} o FULL JOIN {ports_new} n USING (product_id, port_type, name)) WHERE u.change_type IS NOT NULL"""


@query("diff_product_ports", "U4", PORT_DIFF)
def diff_product_ports(d):
    return ct.diff_ports(d["ports_old"], d["ports_new"], "product_id")


@query("diff_product_team", "U4", """
SELECT product_id, member, 'removed' AS change_type, CASE WHEN role = 'Owner' THEN 'breaking' ELSE 'fix' END AS impact FROM {members_old}
WHERE (product_id, member) NOT IN (SELECT (product_id, member) FROM {members_new})
UNION ALL SELECT product_id, member, 'added', 'feature' FROM {members_new} WHERE (product_id, member) NOT IN (SELECT (product_id, member) FROM {members_old})""")
def diff_product_team(d):
    return ct.diff_members(d["members_old"], d["members_new"], "product_id")


@query("diff_product_support", "U4", """
SELECT product_id, channel, 'removed' AS change_type, 'fix' AS impact FROM ((SELECT * FROM {support_old}) EXCEPT (SELECT * FROM {support_new}))
UNION ALL SELECT product_id, channel, 'added', 'feature' FROM ((SELECT * FROM {support_new}) EXCEPT (SELECT * FROM {support_old}))""")
def diff_product_support(d):
    return ct.diff_support(d["support_old"], d["support_new"], "product_id")


DESC_DIFF = " UNION ALL ".join(
    f"SELECT product_id, '{p}' AS part, 'modified' AS change_type, 'fix' AS impact FROM {{products_old}} o JOIN {{products_new}} n USING (product_id) WHERE o.{p} IS DISTINCT FROM n.{p}"
    for p in ct.DESCRIPTION_PARTS)


@query("diff_product_description", "U4", DESC_DIFF)
def diff_product_description(d):
    return ct.diff_descriptions(d["products_old"], d["products_new"], "product_id")


@query("update_impact", "U8", f"""
WITH sections AS (SELECT DISTINCT product_id, port_type || 'Ports' AS section FROM ({PORT_DIFF}) UNION SELECT DISTINCT product_id, 'description' FROM ({DESC_DIFF}))
SELECT o.product_id, concat_ws(',', CASE WHEN n.name <> o.name THEN 'name' END, CASE WHEN n.version <> o.version THEN 'version' END,
  CASE WHEN n.status <> o.status THEN 'status' END, CASE WHEN n.domain <> o.domain THEN 'domain' END) AS metadata_changes,
 COALESCE((SELECT string_agg(section, ',' ORDER BY section) FROM sections s WHERE s.product_id = o.product_id), '') AS child_changes,
 COALESCE(b.b, false) AS requires_versioning, CASE WHEN COALESCE(b.b, false) THEN 'clone' ELSE 'update_in_place' END AS recommended_action
FROM {{products_old}} o JOIN {{products_new}} n USING (product_id)
LEFT JOIN (SELECT product_id, bool_or(impact = 'breaking') AS b FROM ({PORT_DIFF}) GROUP BY 1) b ON b.product_id = o.product_id""")
def update_impact(d):
    ports = ct.diff_ports(d["ports_old"], d["ports_new"], "product_id")
    desc = ct.diff_descriptions(d["products_old"], d["products_new"], "product_id")
    sections = ports.select("product_id", F.concat("port_type", F.lit("Ports")).alias("section")).unionByName(
        desc.select("product_id", F.lit("description").alias("section")))
    return ct.update_impact(d["products_old"], d["products_new"], "product_id", ["name", "version", "status", "domain"], sections, ports)
