from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.functions import similarity as sim
from curatrix.operators import access as ac
from curatrix.operators import compliance as co
from curatrix.operators import contracts as ct
from curatrix.operators import linking as lk
from curatrix.operators import quality as q
from curatrix.operators import search as se
from curatrix.operators import summaries as sm
from curatrix.operators import tagging as tg
from curatrix.plans.safe_sql import UnsafeSql, check_sql, safe_sql
from curatrix.sources import sinks as sk
from curatrix.sources import tables as tb
from curatrix.session import new_shared_path


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_table_names():
    assert tb.full_name("a.b.c") == "a.b.c"
    assert tb.full_name("b.c", "a") == "a.b.c"
    assert tb.full_name("c", "a", "b") == "a.b.c"
    assert tb.full_name("c", "a") is None and tb.full_name("b.c") is None


@pytest.mark.parametrize("text,seconds", [("6h", 21600), ("30m", 1800), ("2d", 172800), ("", 3600), (None, 3600), ("5x", 18000)])
def test_lookback(spark, text, seconds):
    assert tb.lookback_seconds(text) == seconds
    if text is not None:
        assert one(spark, sc.parse_lookback(F.lit(text))) == seconds


def test_templates_and_slugs(spark):
    assert one(spark, sc.render_template("a-{X}-{Y}", {"X": F.lit("1"), "Y": F.lit("2"), "Z": F.lit(None)})) == "a-1-2"
    assert one(spark, sc.render_template("a-{X}", {"X": F.lit(None).cast("string")})) is None
    assert one(spark, sc.slugify_iri(F.lit("http://x.org/Terms#My Term!"))) == "my-term"
    assert one(spark, sc.sanitize_tag_key(F.lit(" a.b:c/d=e "))) == "a_b_c_d_e"


def test_versions(spark):
    assert one(spark, sc.next_version(F.lit("1.2.3"), F.lit("major"))) == "2.0.0"
    assert one(spark, sc.next_version(F.lit("1.2.3-rc"), F.lit("patch"))) == "1.2.4"
    assert one(spark, sc.next_version(F.lit("v1"), F.lit("minor"))) == "1.0.0"


def test_masking(spark):
    assert one(spark, sc.pii_mask(F.lit("x 123-45-6789 y\nPII: name\nz"))) == "x XXX-XX-XXXX y\nPII: [REDACTED]\nz"


def test_similarity_of_missing_text(spark):
    assert one(spark, sim.levenshtein_ratio(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, sim.levenshtein_ratio(F.lit(None).cast("string"), F.lit("a"))) == 0.0
    assert one(spark, sim.token_sort_ratio(F.lit("Smith John"), F.lit("john smith"))) == 1.0


@pytest.mark.parametrize("match,value,expected", [
    ("exact", "Data", 1.0), ("prefix", "database", 1.0), ("prefix", "my data", 0.9), ("prefix", "ns/data", 0.9), ("prefix", "mydata", 0.0), ("substring", "my data", 0.9),
    ("substring", "mydata", 0.8), ("fuzzy", "my data", 0.9), ("fuzzy", "d-a-t-a", 0.7), ("fuzzy", "atd", 0.5), ("fuzzy", "zzz", 0.0), ("fuzzy", "", 0.0)])
def test_search_quality(spark, match, value, expected):
    assert one(spark, se.search_quality(F.lit(value), "DATA", match)) == expected


def test_empty_id_set_yields_no_assets(spark):
    df = spark.createDataFrame([(1, "Table", "n")], "id int, type string, name string")
    assert ac.filter_assets(df, restrict=df.select("id").limit(0)).count() == 0
    assert ac.filter_assets(df).count() == 1


def test_projects_of_a_user_without_team(spark):
    projects = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 11)], "id int, name string, owner_team_id int")
    teams = spark.createDataFrame([(10, 5), (11, None)], "team_id int, domain_id int")
    members = spark.createDataFrame([(10, "Ann")], "team_id int, member string")
    assoc = spark.createDataFrame([(1, 10)], "project_id int, team_id int")
    see = lambda who: [r.name for r in ac.visible_projects(projects, teams, members, assoc, who, []).collect()]
    assert see("bob") == ["b", "c"] and see("ANN") == ["a", "b", "c"]


def test_price_boundaries_and_open_ends(spark):
    usage = spark.createDataFrame([(1, "A", datetime(2024, 1, 31, 23)), (2, "A", datetime(2024, 2, 1)), (3, "B", datetime(2024, 5, 5)), (4, "A", datetime(2023, 1, 1))], "id int, sku_name string, usage_end_time timestamp_ntz")
    prices = spark.createDataFrame([("A", date(2023, 12, 15), date(2024, 2, 1), 1.0), ("A", date(2024, 2, 1), None, 2.0)], "sku_name string, price_start_time date, price_end_time date, price double")
    assert {r.id: r.price for r in lk.price_as_of(usage, prices).collect()} == {1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}


def test_link_schema_is_exact_for_short_and_long_names(spark):
    objects = spark.createDataFrame([(1, "A"), (2, "sales.Orders"), (3, "Plain"), (4, "none")], "object_id int, match_name string")
    assets = spark.createDataFrame([(7, "Plain", "Table", None), (8, "x", "View", "cat.sales.orders_v2"), (9, "y", "Table", "CAT.sales.orders"), (5, "z", "Column", "a")], "id int, name string, type string, location string")
    assert {r.object_id: r.asset_id for r in lk.link_schema_to_assets(objects, assets).collect()} == {1: 8, 2: 8, 3: 7}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_of_campaigns_and_prices_are_never_broadcast(spark):
    sales = spark.sql("SELECT id AS product_id, DATE'2024-03-05' AS sold_on, 2.0D AS amount, id % 2 AS customer_id FROM range(4)")
    campaigns = spark.sql("SELECT 'c' AS campaign, id AS product_id, DATE'2024-01-01' AS start_date, DATE'2030-12-31' AS end_date FROM range(3)")
    out = lk.campaign_sales(sales, campaigns)
    assert "Broadcast" not in plan(out) and [tuple(r) for r in out.collect()] == [("c", 6.0, 2)]
    usage = spark.sql("SELECT id, 'A' AS sku_name, TIMESTAMP_NTZ'2024-01-31 23:00:00' AS usage_end_time FROM range(2)")
    prices = spark.sql("SELECT 'A' AS sku_name, DATE'2023-12-15' AS price_start_time, DATE'2024-02-01' AS price_end_time, 1.5D AS price")
    out = lk.price_as_of(usage, prices)
    assert "BroadcastHashJoin" not in plan(out) and {r.price for r in out.collect()} == {1.5}


@pytest.mark.parametrize("few", [True, False])
def test_substrings_of_locations_are_never_broadcast(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lk, "BROADCAST_ROWS", 1)
    objects = spark.sql("SELECT * FROM VALUES (1, 'A'), (2, 'sales.Orders'), (3, 'Plain'), (4, 'none') AS t(object_id, match_name)")
    assets = spark.sql("SELECT * FROM VALUES (7, 'Plain', 'Table', NULL), (8, 'x', 'View', 'cat.sales.orders_v2'), (9, 'y', 'Table', 'CAT.sales.orders') AS t(id, name, type, location)")
    out = lk.link_schema_to_assets(objects, assets)
    joins = [line for line in plan(out).splitlines() if "BroadcastHashJoin" in line]
    assert all("LeftSemi" in line for line in joins) and len(joins) == int(few)
    assert {r.object_id: r.asset_id for r in out.collect()} == {1: 8, 2: 8, 3: 7}


def test_diff_only_reports_changes(spark):
    cols = "c int, schema_name string, field_name string, logical_type string, required boolean"
    old = spark.createDataFrame([(1, "s", "a", "double", False), (1, "s", "b", "int", True), (1, "gone", "x", "int", True)], cols)
    new = spark.createDataFrame([(1, "s", "a", "float", True), (1, "s", "d", "int", False)], cols)
    got = {(r.schema_name, r.field_name, r.change_type, r.impact) for r in ct.diff_fields(old, new, "c").collect()}
    assert got == {("gone", None, "removed", "breaking"), ("s", "a", "type_changed", "fix"), ("s", "a", "modified", "breaking"), ("s", "b", "removed", "breaking"), ("s", "d", "added", "feature")}
    assert ct.diff_fields(old, old, "c").count() == 0


def test_reconcile_is_empty_when_equal(spark):
    tags = spark.createDataFrame([("t", "gov_a", "1"), ("t", "other", "x")], "object_name string, tag_key string, tag_value string")
    assert tg.reconcile_tags(tags, tags.filter("tag_key = 'gov_a'"), "gov_").count() == 0


def test_trend_fills_missing_days_with_zero(spark):
    runs = spark.createDataFrame([(datetime(2024, 1, 2, 5), 80.0), (datetime(2024, 1, 2, 6), 90.0)], "started_at timestamp_ntz, score double")
    assert sorted((str(r.day), r.score) for r in co.compliance_trend(runs, 3, datetime(2024, 1, 3)).collect()) == [("2024-01-01", 0.0), ("2024-01-02", 85.0), ("2024-01-03", 0.0)]


def test_policies_without_runs_count_zero(spark):
    policies = spark.createDataFrame([(1, "critical", True), (2, "low", False)], "id int, severity string, is_active boolean")
    runs = spark.createDataFrame([(1, 2, datetime(2024, 1, 1), 100.0)], "id int, policy_id int, started_at timestamp_ntz, score double")
    assert tuple(co.compliance_stats(policies, runs).first()) == (50.0, 1, 1)


def test_version_family_falls_back_to_relatives(spark):
    rows = [(1, "a", None, None), (2, "b", None, 1), (3, "c", None, 1), (4, "d", "fam", None), (5, "e", "fam", 9)]
    df = spark.createDataFrame([(*r, "1", datetime(2024, 1, r[0])) for r in rows], "id int, name string, base_name string, parent_contract_id int, version string, created_at timestamp_ntz")
    ids = lambda i: sorted(r.id for r in sm.version_family(df, i).collect())
    assert ids(2) == [1, 2, 3] and ids(1) == [1, 2, 3] and ids(4) == [4, 5]


def test_quarantine_only_when_there_are_bad_rows(spark):
    path = new_shared_path(spark, "t")
    df = spark.createDataFrame([(1,)], "a int")
    assert sk.write_quarantine(df.limit(0), path, "p", datetime(2024, 1, 1)) is None
    assert spark.read.parquet(sk.write_quarantine(df, path, "p", datetime(2024, 1, 1))).count() == 1
    assert spark.read.parquet(sk.write_quarantine(df, path, "p", datetime(2024, 1, 2))).count() == 1  # the run again
    assert spark.read.parquet(sk.write_quarantine(df, path, "q", datetime(2024, 1, 2))).count() == 2


def test_materialize_survives_a_crash_at_any_point(spark, monkeypatch):
    path = new_shared_path(spark, "m")
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "a int")
    rows = lambda: sorted(r.a for r in sk.read_materialized(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        sk.read_materialized(spark, path)
    assert sk.materialize(frame(1), path) == "WRITTEN" and sk.materialize(frame().limit(0), path) == "SKIPPED" and rows() == [1]

    def crash(*_args):
        raise OSError("lost")

    for step in ("_written", "commit"):
        with monkeypatch.context() as m:
            m.setattr(sk, step, crash)
            with pytest.raises(OSError):
                sk.materialize(frame(2), path)
        assert rows() == [1]
    with monkeypatch.context() as m:
        m.setattr(sk, "forget_versions", crash)
        with pytest.raises(OSError):
            sk.materialize(frame(3), path)
    assert rows() == [3]  # committed before the clean-up failed
    reader = sk.read_materialized(spark, path)
    assert sk.materialize(frame(4, 5), path) == "WRITTEN" and rows() == [4, 5]
    assert [r.a for r in reader.collect()] == [3] and len(sk.versions(spark, path)) == 2
    with pytest.raises(ValueError):
        sk.forget_versions(spark, path, 0)


def test_a_catalog_table_follows_its_versions(spark):
    staging, name = new_shared_path(spark, "versions"), "curatrix_versions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for value in (1, 2, 3):
        assert sk.materialize_table(spark.createDataFrame([(value,)], "a int"), name, staging) == "WRITTEN"
        assert [r.a for r in spark.table(name).collect()] == [value]
    assert sk.materialize_table(spark.createDataFrame([], "a int"), name, staging) == "SKIPPED"
    assert sk.materialize_table(spark.createDataFrame([("x", 1)], "b string, a int"), name, staging) == "WRITTEN"
    assert [tuple(r) for r in spark.table(name).collect()] == [("x", 1)]
    spark.sql(f"DROP TABLE {name}")


def test_a_run_written_twice_counts_once(spark):
    path = new_shared_path(spark, "results")
    results = q.run_checks(spark.range(5), [q.value_range("id", maximum=3)], "t")
    for run in ("r1", "r1", "r2"):
        sk.write_results(results, path, run, datetime(2024, 1, 1))
    assert spark.read.parquet(f"{path}/results").count() == 2 and spark.read.parquet(f"{path}/runs").count() == 2


def test_table_by_catalog_name(spark):
    assert sk.materialize_table(spark.range(3), "by_name", new_shared_path(spark, "staged")) == "WRITTEN"
    assert tb.read_table(spark, "by_name", "spark_catalog", "default").count() == 3
    assert tb.read_table(spark, "default.by_name", "spark_catalog", "default").count() == 3
    assert tb.read_table(spark, "spark_catalog.default.by_name", "x", "y").count() == 3
    spark.sql("DROP TABLE by_name")


@pytest.mark.parametrize("text", [
    "DROP TABLE x", "SELECT 1; DELETE FROM t", "SELECT * FROM other", "INSERT INTO t VALUES (1)", "EXPLAIN SELECT 1", "CALL p()", "SET a=1", "SHOW TABLES", "CREATE VIEW v AS SELECT 1", "not sql",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM t", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM text.`/etc/passwd`",
    "SELECT id FROM t WHERE id IN (SELECT id FROM secret)", "SELECT (SELECT max(id) FROM secret) FROM t", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM t JOIN LATERAL (SELECT * FROM secret)",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'getenv', 'HOME'))", "SELECT * FROM range(5)", "SELECT input_file_name() FROM t"])
def test_unsafe_sql_is_refused(spark, text):
    with pytest.raises(UnsafeSql):
        check_sql(spark, text, {"t"})


@pytest.mark.parametrize("text", [
    "SELECT 'a -- b' AS x FROM t", "SELECT 'set aside' FROM t", "SELECT 'please DROP by' -- a comment", "WITH a AS (SELECT id FROM t), b AS (SELECT * FROM a) SELECT count(*) FROM b JOIN a USING (id) GROUP BY id HAVING count(*) > 0 ORDER BY 1",
    "SELECT id, row_number() OVER (PARTITION BY id ORDER BY id) FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.id = t.id)", "SELECT e FROM t LATERAL VIEW explode(sequence(1, 3)) x AS e", "SELECT * FROM (VALUES (1), (2)) v(a) UNION ALL SELECT id FROM t"])
def test_plain_queries_are_accepted(spark, text):
    check_sql(spark, text, {"t"})


def test_safe_sql_limits_rows_and_says_so(spark):
    text = "WITH a AS (SELECT * FROM {t}) SELECT id FROM a WHERE 'update' <> 'drop'"
    rows = safe_sql(spark, text, 5, t=spark.range(50)).collect()
    assert len(rows) == 5 and all(r.truncated for r in rows)
    assert not any(r.truncated for r in safe_sql(spark, text, 50, t=spark.range(50)).collect())
    assert safe_sql(spark, text, t=spark.range(50)).count() == 50
