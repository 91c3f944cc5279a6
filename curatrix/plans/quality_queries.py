"""Registered queries: data-quality checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from curatrix.operators import quality as q
from curatrix.operators.quality import Property
from curatrix.plans.registry import query

CUSTOMER_CONTRACT = [
    Property("c_custkey", "integer", required=True, unique=True),
    Property("C_NAME", "string", required=True, min_length=5, max_length=18, pattern=r"^Customer#[0-9]{9}$"),
    Property("c_acctbal", "number", minimum=0, maximum=9000),
    Property("c_mktsegment", "string", required=True, pattern="^(BUILDING|MACHINERY)$"),
    Property("c_missing", "string", required=True),
]
ORDERS_CONTRACT = [
    Property("o_orderkey", "integer", required=True, unique=True),
    Property("o_custkey", "integer", required=True, unique=True, minimum=100),
    Property("o_totalprice", "number", minimum=1000, maximum=400000),
    Property("o_orderpriority", "string", min_length=5, max_length=10, pattern="^[1-5]-"),
]


def _row(seq, obj, kind, col, count, message):
    return f"""SELECT CAST({seq} AS BIGINT) AS seq, '{obj}' AS object_name, '{kind}' AS check_type, '{col}' AS column_name,
 n = 0 AS passed, CAST(n AS BIGINT) AS violations_count,
 CASE WHEN n = 0 THEN 'ok' ELSE CAST(n AS VARCHAR) || ' violation(s): {message}' END AS message FROM ({count})"""


def _cnt(table, cond):
    return f"SELECT COUNT(*) AS n FROM {table} WHERE {cond}"


def _dup(table, cols):
    return f"SELECT COUNT(*) AS n FROM (SELECT {cols} FROM {table} GROUP BY {cols} HAVING COUNT(*) > 1)"


_CUSTOMER_SQL = " UNION ALL ".join([
    _row(0, "customer", "required", "c_custkey", _cnt("customer", "c_custkey IS NULL"), "null values"),
    _row(1, "customer", "required", "c_name", _cnt("customer", "c_name IS NULL"), "null values"),
    _row(2, "customer", "required", "c_mktsegment", _cnt("customer", "c_mktsegment IS NULL"), "null values"),
    _row(3, "customer", "unique", "c_custkey", _dup("customer", "c_custkey"), "duplicated values"),
    _row(4, "customer", "range", "c_acctbal", _cnt("customer", "c_acctbal < 0 OR c_acctbal > 9000"), "outside [0, 9000]"),
    _row(5, "customer", "length", "c_name", _cnt("customer", "length(c_name) < 5 OR length(c_name) > 18"), "length outside [5, 18]"),
    _row(6, "customer", "pattern", "c_name", _cnt("customer", "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"), "does not match ^Customer#[0-9]{9}$"),
    _row(7, "customer", "pattern", "c_mktsegment", _cnt("customer", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), "does not match ^(BUILDING|MACHINERY)$"),
])
_ORDERS_SQL = " UNION ALL ".join([
    _row(0, "orders", "required", "o_orderkey", _cnt("orders", "o_orderkey IS NULL"), "null values"),
    _row(1, "orders", "required", "o_custkey", _cnt("orders", "o_custkey IS NULL"), "null values"),
    _row(2, "orders", "unique", "o_orderkey", _dup("orders", "o_orderkey"), "duplicated values"),
    _row(3, "orders", "unique", "o_custkey", _dup("orders", "o_custkey"), "duplicated values"),
    _row(4, "orders", "range", "o_custkey", _cnt("orders", "o_custkey < 100"), "outside [100, None]"),
    _row(5, "orders", "range", "o_totalprice", _cnt("orders", "o_totalprice < 1000 OR o_totalprice > 400000"), "outside [1000, 400000]"),
    _row(6, "orders", "length", "o_orderpriority", _cnt("orders", "length(o_orderpriority) < 5 OR length(o_orderpriority) > 10"), "length outside [5, 10]"),
    _row(7, "orders", "pattern", "o_orderpriority", _cnt("orders", "NOT regexp_matches(o_orderpriority, '^[1-5]-')"), "does not match ^[1-5]-"),
])


def contract_results(d):
    """All checks of both contracts: one aggregation per table, plus one for all unique columns."""
    return q.run_contract_checks(d["customer"], "customer", CUSTOMER_CONTRACT).unionByName(
        q.run_contract_checks(d["orders"], "orders", ORDERS_CONTRACT)
    )


@query("contract_checks", "DQ6 DQ1 DQ2 DQ3 DQ4 DQ5 SRC1", f"{_CUSTOMER_SQL} UNION ALL {_ORDERS_SQL}")
def contract_checks(d):
    return contract_results(d)


@query("contract_check_run", "DQ6 SRC8", f"""
SELECT object_name, COUNT(*) FILTER (passed) AS checks_passed, COUNT(*) FILTER (NOT passed) AS checks_failed,
 CAST(SUM(violations_count) AS BIGINT) AS violations, ROUND(100.0 * COUNT(*) FILTER (passed) / COUNT(*), 2)::DOUBLE AS score,
 CASE WHEN COUNT(*) FILTER (NOT passed) = 0 THEN 'succeeded' ELSE 'failed' END AS status
FROM ({_CUSTOMER_SQL} UNION ALL {_ORDERS_SQL}) GROUP BY object_name""")
def contract_check_run(d):
    return q.summarize_run(contract_results(d))


def _counts(name_sql: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS column_name, CAST(n AS BIGINT) AS violations_count FROM ({s})" for n, s in name_sql)


def _brief(df):
    return df.select("column_name", "violations_count")


@query("check_required", "DQ1", _counts([(c, _cnt("{comments}", f"{c} IS NULL")) for c in ("id", "project_id", "audience_csv")]))
def check_required(d):
    return _brief(q.run_checks(d["comments"], [q.required(c) for c in ("id", "project_id", "audience_csv")], "comments"))


@query("check_unique", "DQ2", _counts([("text", _dup("documents", "text")), ("lang,source", _dup("documents", "lang, source")), ("doc_id", _dup("documents", "doc_id"))]))
def check_unique(d):
    docs = d["documents"]
    return _brief(q.check_unique_keys(docs, [["text"], ["lang", "source"], ["doc_id"]], "documents"))


@query("split_unique", "DQ10 DQ7", """
SELECT o_custkey, COUNT(*) AS n FROM (SELECT o_custkey, COUNT(*) OVER (PARTITION BY o_custkey) AS k FROM orders) WHERE k > 1 AND o_custkey IS NOT NULL GROUP BY 1""")
def split_unique(d):
    """Orders whose customer has other orders, as the bad side of a row-level uniqueness rule."""
    rows = q.with_unique_flags(d["orders"], ["o_custkey"])
    _, bad = q.split_rows(rows, [q.RowRule("one_order", q.library_rule("is_unique", "o_custkey"))])
    return bad.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("check_range", "DQ3", _counts([
    ("l_quantity", _cnt("lineitem", "l_quantity < 5 OR l_quantity > 45")),
    ("l_discount", _cnt("lineitem", "l_discount > 0.08")),
    ("l_extendedprice", _cnt("lineitem", "l_extendedprice < 1000"))]))
def check_range(d):
    specs = [q.value_range("l_quantity", 5, 45), q.value_range("l_discount", maximum=0.08), q.value_range("l_extendedprice", 1000)]
    return _brief(q.run_checks(d["lineitem"], specs, "lineitem"))


@query("check_length", "DQ4", _counts([
    ("text", _cnt("documents", "length(text) < 300 OR length(text) > 5000")), ("source", _cnt("documents", "length(source) > 4"))]))
def check_length(d):
    return _brief(q.run_checks(d["documents"], [q.text_length("text", 300, 5000), q.text_length("source", max_length=4)], "documents"))


@query("check_pattern", "DQ5", _counts([
    ("url", _cnt("pages", "NOT regexp_matches(url, 'https://')")), ("html", _cnt("pages", "NOT regexp_matches(html, '<title>')"))])
    + " UNION ALL SELECT 'page_id', COUNT(*) FROM pages")
def check_pattern(d):
    specs = [q.pattern("url", "https://"), q.pattern("html", "<title>"), q.pattern("page_id", "([")]
    return _brief(q.run_checks(d["pages"], specs, "pages"))


NESTED_CONTRACT = [
    Property("customer.ID", required=True, unique=True),
    Property("Lines[].tax", required=True),
    Property("lines[].part", unique=True),
    Property("lines[].qty", minimum=2, maximum=48),
    Property("customer.priority", pattern="^[1-4]-"),
    Property("lines[].flag", enum=("A", "N")),
    Property("lines", max_items=6),
    Property("lines[].gone", required=True),
]


def _with_line(cond):
    return f"SELECT COUNT(DISTINCT o_orderkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {cond}"


@query("nested_contract", "DQ6 DQ1 DQ2 DQ3 DQ5 DQ12 DQ13", " UNION ALL ".join(f"SELECT '{kind}' AS check_type, '{col}' AS column_name, CAST(n AS BIGINT) AS violations_count FROM ({count})" for kind, col, count in [
    ("required", "customer.id", _cnt("orders", "o_custkey IS NULL")),
    ("required", "lines[].tax", _with_line("l_tax > 0.07")),
    ("unique", "customer.id", _dup("orders", "o_custkey")),
    ("unique", "lines[].part", _dup("orders JOIN lineitem ON l_orderkey = o_orderkey", "l_partkey")),
    ("range", "lines[].qty", _with_line("l_quantity < 2 OR l_quantity > 48")),
    ("pattern", "customer.priority", _cnt("orders", "NOT regexp_matches(o_orderpriority, '^[1-4]-')")),
    ("enum", "lines[].flag", _with_line("l_returnflag NOT IN ('A', 'N')")),
    ("items", "lines", "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING COUNT(*) > 6)")]))
def nested_contract(d):
    """A contract over fields of structs and of the elements of arrays."""
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.when(F.col("l_tax") <= 0.07, F.col("l_tax")).alias("tax"), F.col("l_returnflag").alias("flag"))
    lines = d["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    customer = F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    orders = d["orders"].select("o_orderkey", customer.alias("customer")).join(lines, "o_orderkey", "left")
    return q.run_contract_checks(orders, "orders", NESTED_CONTRACT).select("check_type", "column_name", "violations_count")


@query("check_enum", "DQ12", _counts([
    ("o_orderstatus", _cnt("orders", "o_orderstatus NOT IN ('F', 'O')")), ("lang", _cnt("documents", "lang NOT IN ('en', 'fr')"))]))
def check_enum(d):
    return _brief(q.run_checks(d["orders"], [q.enum("o_orderstatus", ["F", "O"])], "orders").unionByName(
        q.run_checks(d["documents"], [q.enum("lang", ["en", "fr"])], "documents")))


_BAD = "(o_totalprice < 5000 OR o_orderdate < TIMESTAMP '1996-01-01')"
_WARN = "(o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED')"


def order_rules():
    rules = [
        q.expr_rule("price_floor", "o_totalprice >= 5000"),
        q.expr_rule("status_closed", "o_orderstatus <> 'P'", "warn"),
        q.expr_rule("not_before_1996", "o_orderdate >= timestamp_ntz '1996-01-01 00:00:00'"),
        q.expr_rule("priority_known", "o_orderpriority <> '4-NOT SPECIFIED'", "warn", "orders"),
        q.expr_rule("other_schema", "o_orderkey < 0", "error", "lineitem"),
    ]
    return q.select_rules(rules, "orders")


@query("split_good_rows", "DQ7 DQ8 DQ9", f"""
SELECT o_orderkey, o_totalprice, concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'status_closed' END,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority_known' END) AS warnings
FROM orders WHERE NOT {_BAD}""")
def split_good_rows(d):
    good, _ = q.split_rows(d["orders"], order_rules())
    return good.select("o_orderkey", "o_totalprice", F.array_join("_warnings", ",").alias("warnings"))


@query("split_bad_rows", "DQ7", f"""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 5000 THEN 'price_floor' END,
  CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'not_before_1996' END) AS errors
FROM orders WHERE {_BAD}""")
def split_bad_rows(d):
    _, bad = q.split_rows(d["orders"], order_rules())
    return bad.select("o_orderkey", F.array_join("_errors", ",").alias("errors"))


@query("split_score", "DQ7", f"""
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (NOT {_BAD}) AS good_rows, COUNT(*) FILTER ({_BAD}) AS bad_rows,
 COUNT(*) FILTER (NOT {_BAD} AND {_WARN}) AS warned_rows, ROUND(100.0 * COUNT(*) FILTER (NOT {_BAD}) / COUNT(*), 2)::DOUBLE AS score_percent
FROM orders""")
def split_score(d):
    return q.split_score(d["orders"], order_rules())


@query("expression_rules", "DQ9", _counts([
    ("ship_after_epoch", _cnt("lineitem", "NOT (l_shipdate > TIMESTAMP '1995-06-01')")),
    ("net_price_positive", _cnt("lineitem", "NOT (l_extendedprice * (1 - l_discount) > 500)")),
    ("null_is_fine", "SELECT 0 AS n")]))
def expression_rules(d):
    rules = [
        q.expression("ship_after_epoch", "l_shipdate > timestamp_ntz '1995-06-01 00:00:00'"),
        q.expression("net_price_positive", "l_extendedprice * (1 - l_discount) > 500"),
        q.expression("null_is_fine", "nullif(l_linenumber, l_linenumber) > 3"),
    ]
    return _brief(q.run_checks(d["lineitem"], rules, "lineitem"))


@query("rule_library", "DQ10", """
SELECT 'is_not_null' AS rule_function, 'completeness' AS dimension, COUNT(*) FILTER (project_id IS NULL) AS violations FROM {comments}
UNION ALL SELECT 'is_not_null_or_empty', 'completeness', COUNT(*) FILTER (audience_csv IS NULL OR trim(audience_csv) = '') FROM {comments}
UNION ALL SELECT 'min_max', 'conformity', COUNT(*) FILTER (id NOT BETWEEN 10 AND 500) FROM {comments}
UNION ALL SELECT 'is_in', 'conformity', COUNT(*) FILTER (status <> 'active') FROM {comments}
UNION ALL SELECT 'pattern', 'conformity', COUNT(*) FILTER (NOT regexp_matches(status, '^act')) FROM {comments}
UNION ALL SELECT 'is_null', 'completeness', COUNT(audience_csv) FROM {comments}
UNION ALL SELECT 'is_unique', 'uniqueness', COALESCE(SUM(n), 0)::BIGINT FROM (SELECT COUNT(*) AS n FROM {comments} WHERE project_id IS NOT NULL GROUP BY project_id HAVING COUNT(*) > 1)""")
def rule_library(d):
    specs = [
        ("is_not_null", "project_id", {}), ("is_not_null_or_empty", "audience_csv", {}),
        ("min_max", "id", {"min": 10, "max": 500}), ("is_in", "status", {"values": ["active"]}), ("pattern", "status", {"regex": "^act"}), ("is_null", "audience_csv", {}),
    ]
    checks = [q.Check(fn, col, ~F.coalesce(q.library_rule(fn, col, **args), F.lit(True))) for fn, col, args in specs]
    counted = q.run_checks(d["comments"], checks, "comments").select("check_type", "violations_count")
    out = counted.unionByName(q.unique_violations(d["comments"], "project_id").withColumn("check_type", F.lit("is_unique")))
    return out.select(
        F.col("check_type").alias("rule_function"), q.rule_dimension(F.col("check_type")).alias("dimension"),
        F.col("violations_count").alias("violations"))


@query("threshold_rules", "DQ11", """
SELECT rule, metric, COALESCE(passed, false) AS passed FROM (
 SELECT 'rows_at_least' AS rule, COUNT(*)::DOUBLE AS metric, COUNT(*) >= 100 AS passed FROM lineitem
 UNION ALL SELECT 'min_qty', MIN(l_quantity), MIN(l_quantity) = 1 FROM lineitem
 UNION ALL SELECT 'max_not_50', MAX(l_quantity), MAX(l_quantity) <> 50 FROM lineitem
 UNION ALL SELECT 'flags', COUNT(DISTINCT l_returnflag)::DOUBLE, COUNT(DISTINCT l_returnflag) BETWEEN 2 AND 3 FROM lineitem
 UNION ALL SELECT 'tax', MAX(l_tax), MAX(l_tax) < 0.05 FROM lineitem
 UNION ALL SELECT 'lines', MAX(l_linenumber)::DOUBLE, NOT (MAX(l_linenumber) BETWEEN 6 AND 9) FROM lineitem)""")
def threshold_rules(d):
    return q.check_thresholds(d["lineitem"], [
        ("rows_at_least", F.count(F.lit(1)), "must_be_ge", 100, None),
        ("min_qty", F.min("l_quantity"), "must_be", 1, None),
        ("max_not_50", F.max("l_quantity"), "must_not_be", 50, None),
        ("flags", F.countDistinct("l_returnflag"), "must_be_between", 2, 3),
        ("tax", F.max("l_tax"), "must_be_lt", 0.05, None),
        ("lines", F.max("l_linenumber"), "must_not_be_between", 6, 9),
    ])


@query("typed_options", "DQ13", """
SELECT 'o_orderdate' AS column_name, COUNT(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '2001-01-01') AS violations_count FROM orders
UNION ALL SELECT 'segments', COUNT(*) FILTER (len(string_split(audience_csv, ',')) < 2) FROM {comments} WHERE audience_csv IS NOT NULL
UNION ALL SELECT 'letters', COUNT(*) FILTER (len(string_split(source, '')) > 4 OR len(list_distinct(string_split(source, ''))) < len(string_split(source, ''))) FROM documents
UNION ALL SELECT 'opts', COUNT(*) FILTER (event_type = 'error') FROM events""")
def typed_options(d):
    dates = q.run_checks(d["orders"], [q.value_range("o_orderdate", "1996-01-01", exclusive_maximum="2001-01-01", as_type="timestamp_ntz")], "orders")
    seg = d["comments"].withColumn("segments", F.split("audience_csv", ","))
    letters = d["documents"].withColumn("letters", F.split("source", ""))
    opts = d["events"].withColumn("opts", F.when(F.col("event_type") != "error", F.create_map(F.lit("k"), F.lit(1))).otherwise(F.create_map(F.lit("z"), F.lit(1))))
    return _brief(
        dates.unionByName(q.run_checks(seg, [q.array_items("segments", min_items=2)], "comments"))
        .unionByName(q.run_checks(letters, [q.array_items("letters", max_items=4, unique_items=True)], "documents"))
        .unionByName(q.run_checks(opts, [q.required_keys("opts", ("k",))], "events")))


@query("freshness_rows", "DQ14", """
SELECT event_type, COUNT(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS fresh, COUNT(*) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00') AS stale,
 MAX(ts) AS newest FROM events GROUP BY event_type""")
def freshness_rows(d):
    fresh = q.row_freshness(F.col("ts"), datetime(2024, 1, 31), 11 * 86400)
    return d["events"].groupBy("event_type").agg(
        F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"), F.max("ts").alias("newest"))


_RANKS = {"signup": 1, "view": 2, "click": 3, "purchase": 4}


@query("sequence_check", "DQ15 W5", """
SELECT event_id, user_id, event_type, prev_event_type FROM (
 SELECT *, LAG(rank) OVER w AS prev_rank, LAG(event_type) OVER w AS prev_event_type FROM (
  SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS rank
  FROM events WHERE event_type <> 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE rank <= prev_rank""")
def sequence_check(d):
    bad = q.sequence_violations(d["events"].select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", "event_type", _RANKS)
    return bad.select("event_id", "user_id", "event_type", "prev_event_type")


@query("volume_floor", "DQ16 W6", """
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2),
 g AS (SELECT event_type, CAST(unnest(generate_series(MIN(day), (SELECT MAX(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day FROM c GROUP BY 1)
SELECT event_type, day, n, ROUND(trailing_avg, 6) AS trailing_avg, COALESCE(n >= 0.8 * trailing_avg, true) AS passed FROM (
 SELECT *, AVG(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_avg FROM (
  SELECT event_type, day, COALESCE(n, 0)::BIGINT AS n FROM g LEFT JOIN c USING (event_type, day)))""")
def volume_floor(d):
    daily = d["events"].groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return q.volume_floor(daily, "day", "n", ("event_type",)).withColumn("trailing_avg", F.round("trailing_avg", 6))


@query("referential_check", "J15", """
SELECT 'missing_customer' AS rule, COUNT(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
UNION ALL SELECT 'blocked_supplier', COUNT(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500)""")
def referential_check(d):
    good = d["customer"].filter("c_mktsegment <> 'MACHINERY'")
    blocked = d["supplier"].filter("s_acctbal < 500")
    a = q.referential_violations(d["orders"].select("o_custkey"), "o_custkey", good, "c_custkey")
    b = q.referential_violations(d["lineitem"].select("l_suppkey"), "l_suppkey", blocked, "s_suppkey", negate=True)
    n = F.count(F.lit(1)).alias("violations")
    return a.agg(n).select(F.lit("missing_customer").alias("rule"), "violations").unionByName(
        b.agg(n).select(F.lit("blocked_supplier").alias("rule"), "violations"))
