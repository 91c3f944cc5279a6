"""Registered queries: aggregate products over flights and sales, geography, scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from curatrix.functions import geo, scalar as sc, similarity as sim
from curatrix.operators import flights as fl
from curatrix.operators import sales as sa
from curatrix.plans.registry import query

AS_OF = datetime(2001, 9, 1)

_LAST = """SELECT flight_key, last_event_type, max_delay_minutes, last_event_ts_utc FROM (
 SELECT flight_key, event_type AS last_event_type, MAX(delay_minutes) OVER (PARTITION BY flight_key) AS max_delay_minutes, event_ts_utc AS last_event_ts_utc,
  ROW_NUMBER() OVER (PARTITION BY flight_key ORDER BY event_ts_utc DESC, event_id DESC, event_type DESC) AS rn FROM {flight_status}) WHERE rn = 1"""
_UNIFIED = f"""SELECT s.*, x.last_event_type, x.max_delay_minutes, x.last_event_ts_utc, a.mtow_kg, a.manufacturer, a.model, p.name AS dep_name, p.city AS dep_city, p.country_iso AS dep_country,
 q.name AS arr_name, q.city AS arr_city, q.country_iso AS arr_country FROM {{schedule}} s LEFT JOIN ({_LAST}) x USING (flight_key) LEFT JOIN {{aircraft}} a USING (tail_number)
 LEFT JOIN {{airports}} p ON p.iata = s.dep_iata LEFT JOIN {{airports}} q ON q.iata = s.arr_iata"""


def _unified(d):
    return fl.flight_ops_unified(d["schedule"], d["flight_status"], d["aircraft"], d["airports"])


@query("last_status", "W3", _LAST)
def last_status(d):
    return fl.last_status(d["flight_status"])


@query("flight_ops_unified", "J10", _UNIFIED)
def flight_ops_unified(d):
    return _unified(d)


@query("flight_daily", "AG21", f"""
SELECT service_date, airline_iata, dep_iata, arr_iata, COUNT(DISTINCT flight_key) AS flight_count, CAST(SUM(seat_capacity) AS BIGINT) AS total_seats, ROUND(AVG(max_delay_minutes), 6) AS avg_delay_minutes,
 COUNT(*) FILTER (last_event_type = 'CANCELLED') AS cancellations, COUNT(*) FILTER (last_event_type = 'DIVERTED') AS diversions FROM ({_UNIFIED}) GROUP BY 1, 2, 3, 4""")
def flight_daily(d):
    return fl.flight_daily(_unified(d))


@query("otp_daily", "AG22", f"""
SELECT *, ROUND(d0_count * 100.0 / flights, 2)::DOUBLE AS d0_pct, ROUND(d15_count * 100.0 / flights, 2)::DOUBLE AS d15_pct, ROUND(d60_count * 100.0 / flights, 2)::DOUBLE AS d60_pct FROM (
 SELECT service_date, airline_iata, COUNT(DISTINCT flight_key) AS flights, COUNT(*) FILTER (COALESCE(max_delay_minutes, 0) <= 0) AS d0_count, COUNT(*) FILTER (COALESCE(max_delay_minutes, 0) <= 15) AS d15_count,
  COUNT(*) FILTER (COALESCE(max_delay_minutes, 0) <= 60) AS d60_count, COUNT(*) FILTER (last_event_type = 'CANCELLED') AS cancellations FROM ({_UNIFIED}) GROUP BY 1, 2)""")
def otp_daily(d):
    return fl.otp_daily(_unified(d))


@query("otp_by_route", "AG23", f"""
SELECT *, ROUND(d15_count * 100.0 / flights, 2)::DOUBLE AS d15_pct FROM (SELECT service_date, dep_iata, arr_iata, COUNT(DISTINCT flight_key) AS flights, ROUND(AVG(max_delay_minutes), 6) AS avg_delay_minutes,
 COUNT(*) FILTER (COALESCE(max_delay_minutes, 0) <= 15) AS d15_count FROM ({_UNIFIED}) GROUP BY 1, 2, 3)""")
def otp_by_route(d):
    return fl.otp_by_route(_unified(d))


@query("flight_carbon", "AG24", """
SELECT flight_key, airline_iata, service_date, dep_iata, arr_iata, tail_number, block_hours, est_fuel_kg, est_co2_kg, ROUND(CAST(est_co2_kg / seat_capacity AS DECIMAL(38, 10)), 2)::DOUBLE AS est_co2_kg_per_seat FROM (
 SELECT *, ROUND(est_fuel_kg * 3.16::DOUBLE, 0) AS est_co2_kg FROM (SELECT *, ROUND(mtow_kg * block_hours * 0.04::DOUBLE, 0) AS est_fuel_kg FROM (
  SELECT s.*, a.mtow_kg, date_diff('second', scheduled_dep_utc, scheduled_arr_utc)::DOUBLE / 3600 AS block_hours FROM {schedule} s LEFT JOIN {aircraft} a USING (tail_number))))""")
def flight_carbon(d):
    return fl.flight_carbon(d["schedule"], d["aircraft"])


@query("duty_compliance", "AG25", """
SELECT log_date, COUNT(log_id) AS logs_count, COUNT(*) FILTER (exceeded) AS exceedances, MAX(flight_duty_period_hours) AS max_fdp_observed, ROUND(AVG(flight_duty_period_hours), 2) AS avg_fdp FROM {duty_logs} GROUP BY 1""")
def duty_compliance(d):
    return fl.duty_compliance(d["duty_logs"])


# ---- sales ----------------------------------------------------------------------------------------------------------


@query("sales_summary", "AG26", """
SELECT date_trunc('month', order_date)::TIMESTAMP AS order_month, country_code, COUNT(DISTINCT order_id) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers, ROUND(SUM(total_amount), 2) AS total_revenue,
 ROUND(AVG(total_amount), 6) AS avg_order_value FROM {s_orders} JOIN {s_customers} USING (customer_id) GROUP BY 1, 2""")
def sales_summary(d):
    return sa.sales_summary(d["s_orders"], d["s_customers"])


@query("customer_360", "AG27", """
SELECT customer_id, customer_segment, country_code, country_name, region, COUNT(DISTINCT order_id) AS total_orders, ROUND(SUM(total_amount), 2) AS total_spent, ROUND(AVG(total_amount), 6) AS avg_order_value,
 MAX(order_date) AS last_order_date, CAST(date_diff('day', MAX(order_date), TIMESTAMP '2001-09-01') AS INT) AS days_since_last_order
FROM {s_customers} LEFT JOIN {s_orders} USING (customer_id) LEFT JOIN {s_countries} USING (country_code) GROUP BY 1, 2, 3, 4, 5""")
def customer_360(d):
    return sa.customer_360(d["s_customers"], d["s_orders"], d["s_countries"], AS_OF)


@query("product_performance", "AG28", """
SELECT p.product_id, product_name, category_name, SUM(quantity) AS total_units_sold, ROUND(SUM(line_total), 2) AS total_revenue, COUNT(DISTINCT o.order_id) AS order_count, ROUND(AVG(unit_price), 6) AS avg_selling_price,
 ROUND((list_price - cost_price) / list_price * 100, 4) AS margin_percent
FROM {s_products} p LEFT JOIN {s_items} i ON i.product_id = p.product_id LEFT JOIN {s_orders} o ON o.order_id = i.order_id GROUP BY 1, 2, 3, list_price, cost_price""")
def product_performance(d):
    return sa.product_performance(d["s_products"], d["s_items"], d["s_orders"])


@query("revenue_by_region", "AG29", """
SELECT region, country_name, date_trunc('quarter', order_date)::TIMESTAMP AS quarter, ROUND(SUM(total_amount), 2) AS total_revenue, COUNT(order_id) AS order_count, COUNT(DISTINCT customer_id) AS customer_count
FROM {s_orders} JOIN {s_customers} USING (customer_id) JOIN {s_countries} USING (country_code) GROUP BY 1, 2, 3""")
def revenue_by_region(d):
    return sa.revenue_by_region(d["s_orders"], d["s_customers"], d["s_countries"])


@query("customer_features", "AG30", """
SELECT customer_id, CAST(date_diff('day', created_at, DATE '2001-09-01') AS INT) AS account_age_days, COUNT(DISTINCT order_id) AS order_count, ROUND(COALESCE(SUM(total_amount), 0), 2) AS total_spent,
 ROUND(COALESCE(AVG(total_amount), 0), 6) AS avg_order_value, ROUND(COALESCE(MAX(total_amount), 0), 2) AS max_order_value, ROUND(COALESCE(MIN(total_amount), 0), 2) AS min_order_value,
 CAST(COALESCE(date_diff('day', MAX(order_date), TIMESTAMP '2001-09-01'), 9999) AS INT) AS recency_days, CASE loyalty_tier WHEN 'PLATINUM' THEN 4 WHEN 'GOLD' THEN 3 WHEN 'SILVER' THEN 2 ELSE 1 END AS loyalty_score
FROM {s_customers} LEFT JOIN {s_orders} USING (customer_id) GROUP BY customer_id, created_at, loyalty_tier""")
def customer_features(d):
    return sa.customer_features(d["s_customers"], d["s_orders"], AS_OF)


# ---- geography --------------------------------------------------------------------------------------------------------

_HAV = "(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))"
_ANGLE = f"(2 * asin(sqrt(least({_HAV}, 1.0))))"


@query("route_legs", "SC17", f"""
SELECT flight_key, ROUND(km, 4) AS distance_km,
 ROUND((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360, 4) AS bearing
FROM (SELECT *, 6371.0 * {_ANGLE} AS km FROM {{legs}})""")
def route_legs(d):
    out = geo.route_legs(d["legs"])
    return out.select("flight_key", F.round("distance_km", 4).alias("distance_km"), F.round("bearing", 4).alias("bearing"))



# ---- scalar functions --------------------------------------------------------------------------------------------------


@query("scalar_names", "SC1 SC2 SC4 SC11 SC12", """
SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(regexp_extract(url, '[^/]*$'), '[^#]*$')), '[^a-z0-9-]', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 replace(replace(replace(replace(replace(replace(trim(url), ',', '_'), '.', '_'), ':', '_'), '-', '_'), '/', '_'), '=', '_') AS tag_key,
 CASE WHEN contains(url, '#') THEN regexp_extract(url, '[^#]*$') ELSE regexp_extract(url, '[^/]*$') END AS local_name,
 CASE page_id % 5 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'Demo Data' WHEN 2 THEN 'Application Entities' WHEN 3 THEN 'p' || page_id END AS context,
 CASE page_id % 3 WHEN 0 THEN 'main.default.t' || page_id WHEN 1 THEN 'main.s.t' || page_id ELSE 'c.s.t' || page_id END AS qualified FROM pages""")
def scalar_names(d):
    c = F.col
    pid = c("page_id").cast("string")
    m5, m3 = c("page_id") % 5, c("page_id") % 3
    graph = (F.when(m5 == 0, F.concat(F.lit("urn:glossary:p"), pid)).when(m5 == 1, "urn:demo:x").when(m5 == 2, "urn:app-entities")
             .when(m5 == 3, F.concat(F.lit("urn:semantic-model:p"), pid)).otherwise("http://else"))
    raw = F.when(m3 == 0, F.concat(F.lit("t"), pid)).when(m3 == 1, F.concat(F.lit("s.t"), pid)).otherwise(F.concat(F.lit("c.s.t"), pid))
    return d["pages"].select(
        "page_id", sc.slugify_iri(c("url")).alias("slug"), sc.sanitize_tag_key(c("url")).alias("tag_key"), sc.local_name(c("url")).alias("local_name"),
        sc.source_context(graph).alias("context"), sc.qualify_name(raw, "main", "default").alias("qualified"))


@query("scalar_templates", "SC3 SC13 SC14 SC15", """
SELECT p_partkey, 'type=' || p_type || ';' || CASE WHEN p_size % 3 <> 0 THEN p_name END AS rendered,
 CASE p_size % 4 WHEN 0 THEN 'en ' || p_name WHEN 1 THEN 'gb ' || p_name WHEN 2 THEN 'none' ELSE 'de ' || p_name END AS label,
 CASE p_size % 3 WHEN 0 THEN CAST(p_size + 1 AS VARCHAR) || '.0.0' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.3.0' ELSE '1.0.0' END AS next,
 CAST(CASE p_size % 3 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 86400 ELSE 3600 END AS BIGINT) AS lookback_seconds FROM part""")
def scalar_templates(d):
    c = F.col
    m4, m3 = c("p_size") % 4, c("p_size") % 3
    labels = (F.when(m4 == 0, F.create_map(F.lit("de"), c("p_name"), F.lit("en"), F.concat(F.lit("en "), "p_name")))
              .when(m4 == 1, F.create_map(F.lit("fr"), c("p_name"), F.lit("en-GB"), F.concat(F.lit("gb "), "p_name")))
              .when(m4 == 2, F.create_map(F.lit("fr"), c("p_name"), F.lit(""), F.lit("none")))
              .otherwise(F.create_map(F.lit("fr"), c("p_name"), F.lit("de"), F.concat(F.lit("de "), "p_name"))))
    version = F.when(m3 == 2, "broken").otherwise(F.concat_ws(".", "p_size", F.lit("2"), F.lit("7-beta")))
    back = F.when(m3 == 0, F.concat(c("p_size").cast("string"), F.lit("m"))).when(m3 == 1, F.concat(c("p_size").cast("string"), F.lit("D"))).otherwise("")
    name = F.when(m3 != 0, c("p_name"))
    return d["part"].select(
        "p_partkey", sc.render_template("type={TYPE};{NAME}", {"TYPE": c("p_type"), "NAME": name, "UNUSED": F.lit(None).cast("string")}).alias("rendered"),
        sc.pick_label(labels, c("p_brand")).alias("label"),
        sc.next_version(version, F.when(m3 == 0, "major").otherwise("minor")).alias("next"), sc.parse_lookback(back).alias("lookback_seconds"))


@query("scalar_contacts", "SC5 SC6 SC7", """
SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 7) AS phone7, lower(trim('  ' || c_name || '@X.ORG ')) AS email,
 '+1' || right('0000000000' || c_custkey, 10) AS e164, concat_ws(' ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_name END) AS full_name FROM customer""")
def scalar_contacts(d):
    c = F.col
    ten = F.lpad(c("c_custkey").cast("string"), 10, "0")
    pretty = F.concat(F.lit("("), F.left(ten, F.lit(3)), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.right(ten, F.lit(4)))
    return d["customer"].select(
        "c_custkey", sc.normalize_phone7(c("c_name")).alias("phone7"), sc.normalize_email(F.concat(F.lit("  "), c("c_name"), F.lit("@X.ORG "))).alias("email"),
        sc.phone_e164(pretty).alias("e164"), F.concat_ws(" ", "c_mktsegment", F.when(c("c_custkey") % 2 == 0, c("c_name"))).alias("full_name"))


@query("similarity_ratio", "SC8 UD1", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE ROUND(1 - levenshtein(lower(p_name), lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 6) END AS ratio,
 ROUND(1 - levenshtein(array_to_string(list_sort(string_split(p_name, ' ')), ' '), p_name)::DOUBLE / length(p_name), 6) AS sorted_ratio FROM part""")
def similarity_ratio(d):
    c = F.col
    other = F.when(c("p_size") % 5 != 0, c("p_type"))
    swapped = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    direct = F.round(1 - F.levenshtein(sim.token_sort(swapped), c("p_name")) / F.length("p_name"), 6)
    return d["part"].select("p_partkey", F.round(sim.similarity(c("p_name"), other), 6).alias("ratio"), direct.alias("sorted_ratio"))


@query("similarity_jaro_winkler", "SC8 UD1", """
SELECT p_partkey, ROUND(jaro_winkler_similarity(lower(p_name), lower(p_brand || ' ' || p_name)), 6) AS jw, ROUND(jaro_winkler_similarity(lower(p_type), lower(p_name)), 6) AS jw_type FROM part""")
def similarity_jaro_winkler(d):
    c = F.col
    return d["part"].select(
        "p_partkey", F.round(sim.similarity(c("p_name"), F.concat_ws(" ", "p_brand", "p_name"), "jaro_winkler"), 6).alias("jw"),
        F.round(sim.similarity(c("p_type"), c("p_name"), "jaro_winkler"), 6).alias("jw_type"))


@query("confidence_bands", "SC9", "SELECT event_id, CASE WHEN value / 100 >= 0.95 THEN 'exact' WHEN value / 100 >= 0.85 THEN 'fuzzy' ELSE 'probabilistic' END AS match_type FROM events")
def confidence_bands(d):
    return d["events"].select("event_id", sc.match_type(F.col("value") / 100).alias("match_type"))


@query("month_bounds", "SC16", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month_end FROM orders")
def month_bounds(d):
    return d["orders"].select("o_orderkey", sc.month_start(F.col("o_orderdate")).alias("month_start"), sc.month_end_exclusive(F.col("o_orderdate")).alias("month_end"))


_DTYPES = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 9 WHEN 0 THEN 'ARRAY<int>' WHEN 1 THEN 'struct<a:date>' WHEN 2 THEN 'timestamp_ntz' WHEN 3 THEN 'decimal(10,2)' WHEN 4 THEN 'bigint'
 WHEN 5 THEN 'boolean' WHEN 6 THEN 'varchar(10)' WHEN 7 THEN 'point' ELSE 'blob' END AS dtype FROM {lineitem}"""


@query("logical_types", "SC20", f"""
SELECT dtype, COUNT(*) AS n, CASE dtype WHEN 'ARRAY<int>' THEN 'array' WHEN 'struct<a:date>' THEN 'object' WHEN 'timestamp_ntz' THEN 'date' WHEN 'decimal(10,2)' THEN 'number' WHEN 'bigint' THEN 'integer'
 WHEN 'boolean' THEN 'boolean' WHEN 'point' THEN 'integer' ELSE 'string' END AS logical FROM ({_DTYPES}) GROUP BY 1""")
def logical_types(d):
    rows = d.sql(_DTYPES).select("dtype", sc.logical_type(F.col("dtype")).alias("logical"))
    return rows.groupBy("dtype", "logical").agg(F.count(F.lit(1)).alias("n"))


@query("pii_mask", "SC21", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text || chr(10) || 'PII: ' || source, 'PII:[^\n]*', 'PII: [REDACTED]', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 'XXX-XX-XXXX', 'g')) AS masked FROM documents""")
def pii_mask(d):
    text = F.concat(F.col("text"), F.lit("\nPII: "), F.col("source"))
    return d["documents"].select("doc_id", F.md5(sc.pii_mask(text)).alias("masked"))


@query("json_payloads", "SC22", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_payloads(d):
    return d["events"].select("event_id", sc.json_field(F.col("props"), "$.k").try_cast("bigint").alias("k"))


@query("option_payloads", "SC22", """
SELECT object_id, name, CAST(json_extract_string(j, '$.minLength') AS INT) AS min_length, json_extract_string(j, '$.minimum') AS minimum FROM (
 SELECT object_id, name, CASE WHEN json_valid(options_json) THEN options_json::JSON END AS j FROM {contract_properties})""")
def option_payloads(d):
    o = sc.parse_options(F.col("options_json"))
    return d["contract_properties"].select("object_id", "name", o["minLength"].alias("min_length"), o["minimum"].alias("minimum"))
