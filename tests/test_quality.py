from datetime import datetime, timedelta
from random import Random

from hypothesis import given, settings
from hypothesis import strategies as hs

from curatrix.operators import contracts as ct
from curatrix.operators import profiling as pf
from curatrix.operators import quality as q
from curatrix.operators.quality import Property
from curatrix.operators.skew import first_per_key, hot_keys, in_ranges, left_join_parts, previous_in_order, salted_join
from pyspark.sql import functions as F


def test_empty_table_passes_with_zero(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = q.run_contract_checks(df, "t", [Property("a", required=True, unique=True, minimum=1), Property("B", pattern="x")]).collect()
    assert [(r.check_type, r.passed, r.violations_count) for r in sorted(rows, key=lambda r: r.seq)] == [
        ("required", True, 0), ("unique", True, 0), ("range", True, 0), ("pattern", True, 0)]


def test_unknown_columns_are_skipped_and_no_checks_score_zero(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = q.run_contract_checks(df, "t", [Property("zz", required=True)])
    assert out.count() == 0
    total = q.summarize_run(q.run_contract_checks(df, "t", [Property("a", required=True)])).first()
    assert (total.checks_passed, total.score, total.status) == (1, 100.0, "succeeded")


def test_null_is_one_duplicate_group_but_no_range_violation(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (50,)], "a int")
    assert q.check_unique(df, ["a"], "t").first().violations_count == 1
    assert q.run_checks(df, [q.value_range("a", 2, 40)], "t").first().violations_count == 2


def test_all_unique_keys_in_one_more_scan(spark, tmp_path):
    rng = Random(3)
    rows = [(rng.choice([None, 1, 2, 3 + i]), rng.choice([None, "", "a", str(i)]), rng.choice([0.0, -0.0, float("nan"), float(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    keys = [["a"], ["b"], ["a", "b"], ["b", "a"], ["c"]]
    got = [r.violations_count for r in sorted(q.check_unique_keys(df, keys, "t", 4).collect(), key=lambda r: r.seq)]
    assert got == [q.duplicate_groups(df, k).count() for k in keys]
    df.write.parquet(str(tmp_path / "t"))
    props = [Property("a", required=True, unique=True), Property("b", unique=True), Property("c", unique=True)]
    plan = q.run_contract_checks(spark.read.parquet(str(tmp_path / "t")), "t", props)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_shifted_nulls_are_different_values(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert q.check_unique(df, ["x", "y"], "t").first().violations_count == 1


def test_unique_flags_need_no_window(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, None), (None, "c")], "x int, y string")
    out = q.with_unique_flags(df, ["x", "y"])
    got = sorted(((r.x, r.y, r._unique_x, r._unique_y) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", False, True), (1, "b", False, False), (2, "b", True, False), (None, None, True, True), (None, "c", True, True)], key=str)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    good, bad = q.split_rows(out, [q.RowRule("one", q.library_rule("is_unique", "x"))])
    assert (good.count(), bad.count()) == (3, 2)


def test_nested_fields_are_checked_by_path(spark):
    rows = [
        (1, ("Rome", None), [("a", 1, [1, 2]), ("b", None, [2])], ["x"]),
        (2, None, [], []),
        (3, (None, "z"), None, None),
        (4, ("Oslo", "z"), [None, ("a", 90, None)], ["x", None, "long"]),
    ]
    df = spark.createDataFrame(rows, "id int, Place struct<City: string, zip: string>, items array<struct<sku: string, n: int, marks: array<int>>>, tags array<string>")
    props = [
        Property("place.city", required=True), Property("ITEMS[].n", required=True, maximum=50), Property("tags[]", required=True, max_length=2),
        Property("items[].sku", unique=True, enum=("a",)), Property("items[].marks", max_items=1), Property("items[].marks[]", unique=True, minimum=2),
        Property("place.zip", unique=True), Property("place.nothing", required=True), Property("items.sku", required=True)]
    got = {(r.check_type, r.column_name): r.violations_count for r in q.run_contract_checks(df, "t", props).collect()}
    assert got == {
        ("required", "Place.City"): 1, ("required", "items[].n"): 1, ("required", "tags[]"): 1, ("unique", "items[].sku"): 1, ("unique", "items[].marks[]"): 1, ("unique", "Place.zip"): 2,
        ("range", "items[].n"): 1, ("range", "items[].marks[]"): 1, ("length", "tags[]"): 1, ("enum", "items[].sku"): 1, ("items", "items[].marks"): 1}


def test_declared_paths_against_the_nested_schema(spark):
    props = [(1, None, 9, "items", "array", "object"), (2, 1, 9, "sku", "string", None), (3, 1, 9, "marks", "array", "int"), (4, None, 9, "place", "struct", None), (5, 4, 9, "city", "string", None),
             (6, 77, 9, "lost", "string", None), (7, 8, 9, "ring", "object", None), (8, 7, 9, "ring2", "object", None)]
    frame = spark.createDataFrame(props, "id int, parent_id int, object_id int, name string, logical_type string, items_logical_type string")
    declared = ct.declared_paths(frame).withColumn("object_name", F.lit("t")).drop("object_id")
    assert sorted(r.column_name for r in declared.collect()) == ["items", "items[]", "items[].marks", "items[].marks[]", "items[].sku", "lost", "place", "place.city"]
    df = spark.createDataFrame([], "items array<struct<SKU: int, marks: array<int>>>, place struct<city: string, zip: string>")
    drift = {r.column_name: r.drift for r in ct.schema_drift(ct.schema_rows(df, "t", nested=True), declared, ["object_name"]).collect()}
    assert drift["items[].sku"] == "type_mismatch" and drift["items[].marks[]"] == "ok" and drift["place.zip"] == "extra" and drift["lost"] == "missing" and drift["place.city"] == "ok"
    assert ct.property_paths(frame.limit(0)).count() == 0


def test_invalid_pattern_is_a_failed_rule_error(spark):
    df = spark.createDataFrame([("x",)], "a string")
    row = q.run_checks(df, [q.pattern("a", "(")], "t").first()
    assert (row.check_type, row.passed) == ("rule_error", False)


def test_unreadable_table_gives_one_failed_result(spark):
    rows = q.checked_table(spark, lambda: spark.table("nowhere.at_all"), "gone", []).collect()
    assert [(r.check_type, r.passed) for r in rows] == [("table_access", False)]


@settings(max_examples=8, deadline=None)
@given(hs.lists(hs.tuples(hs.one_of(hs.none(), hs.integers(-5, 5)), hs.sampled_from(["a", "b", None])), max_size=30))
def test_good_and_bad_partition_the_input(spark, rows):
    df = spark.createDataFrame(rows, "n int, s string")
    rules = [q.expr_rule("positive", "n > 0"), q.expr_rule("is_a", "s = 'a'", "warn")]
    good, bad = q.split_rows(df, rules)
    n_bad = sum(1 for n, _ in rows if n is not None and n <= 0)
    assert (good.count(), bad.count()) == (len(rows) - n_bad, n_bad)
    score = q.split_score(df, rules).first()
    assert 0 <= score.score_percent <= 100 and score.total_rows == len(rows)


def test_empty_split_scores_100(spark):
    assert q.split_score(spark.createDataFrame([], "n int"), [q.expr_rule("p", "n > 0")]).first().score_percent == 100.0


def test_one_key_at_one_instant_lies_in_many_ranges(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 9 == 0 else 1, start + timedelta(seconds=i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_ranges(df, ["k"], "ts", "id").groupBy("_range").count().collect()]
        got = {r.id: r.prev_id for r in previous_in_order(df, ["k"], "ts", "id", ["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 450
    want, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1] is not None, r[2], r[0])):
        want[i] = last.get(k)
        last[k] = i
    assert got == want


def test_frequent_values_equal_full_counts(spark):
    rnd = Random(8)
    rows = [(rnd.choice("aaab") if i % 3 else rnd.choice("abcdefgh"), i, rnd.randint(0, 300) if i % 5 else None, None, i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "hot string, apart int, many int, nothing string, two int")
    for buckets in (1, 16, 8192):
        got = sorted(map(tuple, pf.frequent_values(df, k=3, buckets=buckets).collect()))
        assert got == sorted(map(tuple, pf.top_values(pf.value_counts(df), 3).collect()))
    assert pf.frequent_values(df.limit(0)).count() == 0


def test_previous_in_order_equals_a_plain_lag(spark):
    rnd = Random(3)
    start = datetime(2024, 1, 1)
    # one key owns most rows
    rows = [(i, 1 if rnd.random() < 0.7 else rnd.randint(2, 5), start + timedelta(hours=rnd.randint(0, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz")
    got = {r.id: r.prev_id for r in previous_in_order(df, ["k"], "ts", "id", ["id"]).collect()}
    want, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = last.get(k)
        last[k] = i
    assert got == want


def test_salted_join_equals_a_plain_join(spark):
    left = spark.range(3000).select(F.col("id").alias("l"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.when(F.col("id") < 12, 7).when(F.col("id") < 30, 900).otherwise(F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, salted_join(left, right, ["k"], how, hot_keys(left, ["k"], 0.1), 5).collect()), key=str)
        b = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert a == b, how
    assert hot_keys(left, ["k"], 0.1).count() == 1


def test_left_join_in_parts_equals_a_left_join(spark):
    left = spark.range(20).select(F.col("id").alias("k"), F.lit("x").alias("a"))
    right = spark.createDataFrame([(3, 1, None), (3, 2, "b"), (5, 3, "c"), (99, 4, "d")], "k long, v int, w string")
    b = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    for hot in (None, spark.createDataFrame([(3,), (4,), (99,)], "k long")):
        assert sorted(map(tuple, left_join_parts(left, right, ["k"], hot).collect()), key=str) == b


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    out = first_per_key(df, ["k"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in out.collect()) == [94, 95, 96, 97, 98, 99]
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and plan.index("Partial") > 0
