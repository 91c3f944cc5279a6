"""Registered queries: sources, sinks, read-only SQL, streaming."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curatrix.operators import contracts as ct
from curatrix.operators import quality as q
from curatrix.operators.quality import Property
from curatrix.plans.registry import query
from curatrix.plans.safe_sql import safe_sql
from curatrix.session import new_shared_path
from curatrix.sources import contracts as co
from curatrix.sources import sinks as sk
from curatrix.sources import tables as tb
from curatrix.sources.triples import RDFS, parse_ntriples
from curatrix.streaming import jobs as st

AT = datetime(2024, 2, 1)


@query("read_table", "SRC1", "SELECT p_partkey, p_name, p_size FROM part")
def read_table(d):
    """A catalog table by its one-part name; names that cannot be completed give nothing."""
    d["part"].write.mode("overwrite").option("path", new_shared_path(d.spark, "part")).saveAsTable("curatrix_part")
    assert tb.read_table(d.spark, "lonely", catalog=None) is None
    return tb.read_table(d.spark, "curatrix_part", "spark_catalog", d.spark.catalog.currentDatabase()).select("p_partkey", "p_name", "p_size")


@query("file_freshness", "DQ18", "SELECT label, passed FROM (VALUES ('recent', true), ('old', false)) v(label, passed), (SELECT COUNT(*) AS n FROM nation) WHERE n > 0")
def file_freshness(d):
    """Freshness by the modification time of files, one hour and thirty hours after they were written."""
    path = new_shared_path(d.spark, "nation")
    d["nation"].write.parquet(path)
    last = ct.file_modified(d.spark, path)
    written = last.first()["last_modified"]
    judged = [ct.table_freshness(last, written + timedelta(hours=h), 24).select(F.lit(label).alias("label"), "passed") for label, h in (("recent", 1), ("old", 30))]
    return judged[0].unionByName(judged[1])


@query("checked_tables", "SRC1 DQ6", """
SELECT object_name, check_type, passed FROM (SELECT 'part' AS object_name, 'required' AS check_type, COUNT(*) = 0 AS passed FROM part WHERE p_name IS NULL UNION ALL SELECT 'part', 'unique', COUNT(*) = 0 FROM (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1))
UNION ALL SELECT 'gone', 'table_access', false""")
def checked_tables(d):
    props = [Property("p_name", required=True, unique=True)]
    good = q.checked_table(d.spark, lambda: d["part"], "part", props)
    gone = q.checked_table(d.spark, lambda: d.spark.read.parquet(d.path("no_such_table")), "gone", props)
    return good.unionByName(gone).select("object_name", "check_type", "passed")


@query("load_contracts", "SRC2 J1 J2 SC4", """
SELECT c.id AS contract_id, o.id AS object_id, p.name AS property_name, p.logical_type, CASE WHEN json_valid(options_json) THEN CAST(json_extract_string(options_json, '$.minLength') AS INT) END AS min_length,
 CASE len(string_split(o.physical_name, '.')) WHEN 3 THEN o.physical_name WHEN 2 THEN 'main.' || o.physical_name ELSE 'main.default.' || o.physical_name END AS table_name
FROM {contracts} c JOIN {contract_objects} o ON o.contract_id = c.id LEFT JOIN {contract_properties} p ON p.object_id = o.id WHERE lower(c.status) IN ('active', 'approved')""")
def load_contracts(d):
    out = co.load_contracts(d["contracts"], d["contract_objects"], d["contract_properties"], ["ACTIVE", "approved"], "main", "default")
    return out.select("contract_id", "object_id", "property_name", "logical_type", F.col("options.minLength").alias("min_length"), "table_name")


@query("read_scoped", "SRC3 SC15", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 36 HOUR")
def read_scoped(d):
    return tb.read_scoped(d["events"], "time-window", "ts", "36h", datetime(2024, 1, 30)).select("event_id")


@query("sample_rows", "SRC4", "SELECT doc_id, lang, true AS truncated FROM documents ORDER BY doc_id LIMIT 100")
def sample_rows(d):
    return tb.sample_rows(d["documents"].select("doc_id", "lang"), 100, ["doc_id"])


@query("materialize", "SRC5", "SELECT n_name, r_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def materialize(d):
    path = new_shared_path(d.spark, "materialize")
    n = d["customer"].join(d["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(d["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    sk.materialize(n.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers")), path)
    sk.materialize(d["nation"].filter("n_nationkey < 0"), path)
    return sk.read_materialized(d.spark, path)


@query("copy_table", "SRC6", "SELECT * FROM supplier")
def copy_table(d):
    path = new_shared_path(d.spark, "copy")
    sk.copy_table(d.spark, d.path("supplier"), path)
    return d.spark.read.parquet(path)


@query("write_quarantine", "SRC7", "SELECT event_id, event_type, TIMESTAMP '2024-02-01' AS _validated_at, 'nightly' AS _pipeline_id FROM events WHERE value < 5 OR event_type = 'error'")
def write_quarantine(d):
    rules = [q.expr_rule("value_floor", "value >= 5"), q.expr_rule("no_errors", "event_type <> 'error'")]
    _, bad = q.split_rows(d["events"], rules)
    path = sk.write_quarantine(bad, new_shared_path(d.spark, "events"), "nightly", AT)
    return d.spark.read.parquet(path).select("event_id", "event_type", "_validated_at", "_pipeline_id")


@query("write_results", "SRC8", """
SELECT 'run1' AS run_id, COUNT(*) FILTER (v = 0) AS checks_passed, COUNT(*) FILTER (v > 0) AS checks_failed, CAST(SUM(v) AS BIGINT) AS violations, ROUND(100.0 * COUNT(*) FILTER (v = 0) / COUNT(*), 2)::DOUBLE AS score,
 CASE WHEN SUM(v) = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT COUNT(*) FILTER (l_quantity > 45) AS v FROM lineitem UNION ALL SELECT COUNT(*) FILTER (l_tax > 1) FROM lineitem UNION ALL SELECT COUNT(*) FILTER (l_partkey IS NULL) FROM lineitem)""")
def write_results(d):
    path = new_shared_path(d.spark, "results")
    checks = [q.value_range("l_quantity", maximum=45), q.value_range("l_tax", maximum=1), q.required("l_partkey")]
    sk.write_results(q.run_checks(d["lineitem"], checks, "lineitem"), path, "run1", AT)
    return d.spark.read.parquet(f"{path}/runs").drop("recorded_at")


@query("read_asset_csv", "SRC11", "SELECT CAST(id AS VARCHAR) AS id, name, type, platform, location FROM {assets}")
def read_asset_csv(d):
    path = new_shared_path(d.spark, "assets-csv")
    cols = ["id", "name", "type", "platform", "location"]
    d["assets"].select(*cols).write.csv(path, header=True, quote='"', escape='"')
    return tb.read_asset_csv(d.spark, path, cols)


@query("read_contract_json", "SRC12", """
SELECT CAST(o_orderkey AS VARCHAR) AS contract_id, 'tbl_' || (o_custkey % 10) AS object_name, p.name AS property_name, p.t AS logical_type, p.r AS required, p.mn AS minimum, p.mx AS max_length FROM orders,
 (VALUES ('a', 'integer', true, '0', NULL), ('b', 'string', false, NULL, 12)) p(name, t, r, mn, mx)""")
def read_contract_json(d):
    path = new_shared_path(d.spark, "contracts-json")
    opt = lambda lo, hi: F.struct(F.lit(lo).cast("string").alias("minimum"), F.lit(hi).cast("int").alias("maxLength"))
    col = lambda n, t, r, o: F.struct(F.lit(n).alias("name"), F.lit(t).alias("logicalType"), F.lit(r).cast("boolean").alias("required"), o.alias("logicalTypeOptions"))
    props = F.array(col("a", "integer", True, opt("0", None)), col("b", "string", None, opt(None, 12)))
    obj = F.struct(F.concat(F.lit("tbl_"), F.col("o_custkey") % 10).alias("name"), props.alias("properties"))
    d["orders"].select(F.col("o_orderkey").cast("string").alias("id"), F.lit("Active").alias("status"), F.array(obj).alias("schema")).write.json(path)
    return co.contract_properties(co.read_contract_json(d.spark, path, multiline=False))


@query("safe_sql", "UD5", "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, false AS truncated FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def safe_sql_query(d):
    return safe_sql(d.spark, "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1", orders=d["orders"])


# ---- streaming ------------------------------------------------------------------------------------------------------------


def _stream(d, order=(0, 1, 2)):
    """The events as three files, by default in the order of time, one per batch, so that later batches meet the state of earlier ones."""
    path = new_shared_path(d.spark, "events-in")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    cuts = d["events"].agg(F.percentile_approx(second, [1 / 3, 2 / 3])).first()[0] or [0, 0]
    third = F.when(second <= cuts[0], 0).when(second <= cuts[1], 1).otherwise(2)
    for i in order:
        d["events"].filter(third == i).coalesce(1).write.mode("append").parquet(path)
    return st.read_files(d.spark, path, d["events"].schema, files_per_trigger=1)


def _done(handle):
    handle.awaitTermination()


def _value_rules():
    return [q.expr_rule("value_floor", "value >= 5"), q.expr_rule("no_errors", "event_type <> 'error'"), q.expr_rule("small", "value < 50", "warn")]


@query("stream_enforce_good", "ST1 SRC14", "SELECT event_id, CASE WHEN value >= 50 THEN 'small' ELSE '' END AS warnings FROM events WHERE value >= 5 AND event_type <> 'error'")
def stream_enforce_good(d):
    base = new_shared_path(d.spark, "enforce")
    _done(st.stream_enforce(_stream(d), _value_rules, base))
    return st.read_sink(d.spark, f"{base}/good").select("event_id", F.array_join("_warnings", ",").alias("warnings"))


@query("stream_enforce_quarantine", "ST1 SRC7", "SELECT event_id, concat_ws(',', CASE WHEN value < 5 THEN 'value_floor' END, CASE WHEN event_type = 'error' THEN 'no_errors' END) AS errors FROM events WHERE value < 5 OR event_type = 'error'")
def stream_enforce_quarantine(d):
    base = new_shared_path(d.spark, "enforce")
    _done(st.stream_enforce(_stream(d), _value_rules, base))
    return st.read_sink(d.spark, f"{base}/quarantine").select("event_id", F.array_join("_errors", ",").alias("errors"))


@query("stage_events", "ST2", "SELECT event_id, user_id, event_type FROM events")
def stage_events(d):
    base = new_shared_path(d.spark, "stage")
    twice = _stream(d, (2, 0, 1)).unionByName(_stream(d))  # late first arrivals, and late repeats
    _done(st.stage_events(twice, "event_id", "ts", base))
    return st.read_sink(d.spark, f"{base}/events").select("event_id", "user_id", "event_type")


_HOURLY = """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2, 3"""


@query("event_volume", "ST3", _HOURLY)
def event_volume(d):
    base = new_shared_path(d.spark, "volume")
    _done(st.append_sink(st.event_volume(_stream(d), "ts", "event_type"), base, "volume"))
    return st.read_sink(d.spark, f"{base}/volume").unionByName(st.open_windows(d.spark, base, "event_type"))


@query("event_volume_sliding", "ST3", f"""
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS w FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY 1, 2, 3""")
def event_volume_sliding(d):
    base = new_shared_path(d.spark, "sliding")
    _done(st.append_sink(st.event_volume(_stream(d), "ts", "event_type", "1 hour", "15 minutes"), base, "volume"))
    return st.read_sink(d.spark, f"{base}/volume").unionByName(st.open_windows(d.spark, base, "event_type"))


@query("volume_drop_alert", "ST4", f"""
WITH c AS ({_HOURLY}), g AS (SELECT event_type, unnest(generate_series(MIN(window_start), (SELECT MAX(window_start) FROM c), INTERVAL 1 HOUR)) AS window_start FROM c GROUP BY 1),
 f AS (SELECT event_type, window_start, COALESCE(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (event_type, window_start))
SELECT window_start, event_type, n, ROUND(trailing_avg, 6) AS trailing_avg FROM (SELECT *, AVG(n) OVER (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_avg FROM f) WHERE n < 0.6 * trailing_avg""")
def volume_drop_alert(d):
    base = new_shared_path(d.spark, "alerts")
    _done(st.volume_drop_alert(st.event_volume(_stream(d), "ts", "event_type"), "event_type", base))
    return st.read_sink(d.spark, f"{base}/alerts").unionByName(st.open_alerts(d.spark, base, "event_type")).select("window_start", "event_type", "n", F.round("trailing_avg", 6).alias("trailing_avg"))


@query("session_activity", "ST5", f"""
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 2 HOUR AS session_end, COUNT(*) AS events FROM (
 SELECT *, SUM(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
GROUP BY user_id, s""")
def session_activity(d):
    base = new_shared_path(d.spark, "sessions")
    _done(st.append_sink(st.session_activity(_stream(d), "ts", "user_id", "2 hours"), base, "sessions"))
    return st.read_sink(d.spark, f"{base}/sessions").unionByName(st.open_sessions(d.spark, base, "user_id"))


@query("current_state", "ST6", """
SELECT user_id, event_id, event_type, value, b_type AS before_event_type, b_value AS before_value FROM (SELECT *, LAG(event_type) OVER w AS b_type, LAG(value) OVER w AS b_value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1""")
def current_state(d):
    base = new_shared_path(d.spark, "state")
    _done(st.current_state(_stream(d), "user_id", ["ts", "event_id"], ["event_type", "value"], base))
    return st.read_state(d.spark, base, "user_id").select("user_id", "event_id", "event_type", "value", "before_event_type", "before_value")


@query("incremental_sync", "ST7 SRC10", f"""
SELECT DISTINCT 'http://x.org/user/' || user_id AS subject, '{RDFS}label' AS predicate, event_type AS object FROM events""")
def incremental_sync(d):
    base = new_shared_path(d.spark, "sync")
    line = F.concat(F.lit("<http://x.org/user/"), F.col("user_id").cast("string"), F.lit(f'> <{RDFS}label> "'), F.col("event_type"), F.lit('" .'))
    triples = parse_ntriples(_stream(d).select(line.alias("value")), "urn:glossary:events")
    _done(st.incremental_sync(d.spark, triples, base))
    return st.read_sink(d.spark, f"{base}/triples").select("subject", "predicate", "object")


@query("stream_freshness", "ST8", "SELECT user_id, MAX(ts) AS last_seen FROM events GROUP BY 1 HAVING MAX(ts) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR")
def stream_freshness(d):
    base = new_shared_path(d.spark, "freshness")
    _done(st.stream_freshness(_stream(d), "user_id", "ts", base))
    return st.stale_keys(d.spark, base, "user_id", datetime(2024, 1, 31), 12 * 3600)


@query("stream_fan_out", "ST9 J18", "SELECT event_id, product_id, subscriber, event_type FROM events e JOIN {subscriptions} s ON s.product_id = e.user_id")
def stream_fan_out(d):
    base = new_shared_path(d.spark, "fanout")
    e = _stream(d).select("event_id", F.col("user_id").alias("product_id"), "event_type")
    _done(st.stream_fan_out(e, d["subscriptions"], base))
    return st.read_sink(d.spark, f"{base}/notifications")
