from pyspark.sql import functions as F
from pyspark.sql import types as T

import pytest

from curatrix.functions import predicates as p


def values(spark, schema, rows, **cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_equality_treats_null_as_a_value(spark):
    got = values(spark, "a string", [("x",), (None,)], eq=p.equals(F.col("a"), None), ne=p.differs(F.col("a"), "x"))
    assert got == [(False, False), (True, True)]


def test_ordering_with_null_is_false(spark):
    got = values(spark, "a int", [(5,), (None,)], gt=p.compare(F.col("a"), ">", 3), le=p.compare(F.col("a"), "<=", 3))
    assert got == [(True, False), (False, False)]


def test_matches_is_anchored_at_the_start_only(spark):
    got = values(spark, "a string", [("abc",), ("xabc",), (None,)], m=p.matches(F.col("a"), "ab|zz"))
    assert got == [(True,), (False,), (False,)]


def test_membership(spark):
    got = values(spark, "a string", [("x",), (None,)], plain=p.member_of(F.col("a"), ["x"]), with_null=p.member_of(F.col("a"), ["y", None]))
    assert got == [(True, False), (False, True)]
    with pytest.raises(TypeError):
        p.member_of(F.col("a"), "x")


def test_contains_by_type(spark):
    rows = [(["a"], {"k": "v"}, "hay"), (None, None, None)]
    got = values(spark, "l array<string>, m map<string,string>, s string", rows, l=p.contains(F.col("l"), "a", T.ArrayType(T.StringType())),
                 m=p.contains(F.col("m"), "k", T.MapType(T.StringType(), T.StringType())), s=p.contains(F.col("s"), "a"))
    assert got == [(True, True, True), (False, False, False)]


def test_truthiness(spark):
    rows = [(0, "", []), (1, "x", ["y"]), (None, None, None)]
    got = values(spark, "n int, s string, l array<string>", rows, n=p.truthy(F.col("n"), T.IntegerType()), s=p.truthy(F.col("s"), T.StringType()),
                 l=p.truthy(F.col("l"), T.ArrayType(T.StringType())))
    assert got == [(False,) * 3, (True,) * 3, (False,) * 3]


def test_missing_tag_and_property(spark):
    df = spark.createDataFrame([({"a": "1"}, "n")], "tags map<string,string>, name string")
    row = df.select(p.tag(F.col("tags"), "zz"), p.has_tag(F.col("tags"), "a"), p.prop(df, "obj.name"), p.prop(df, "obj.other", "tags")).first()
    assert tuple(row) == (None, True, "n", None)


def test_text_functions_on_null(spark):
    assert values(spark, "a string", [(None,)], n=p.length0(F.col("a")), u=p.upper0(F.col("a")), l=p.lower0(F.col("a"))) == [(0, "", "")]


def test_case_without_else(spark):
    assert values(spark, "a int", [(1,), (2,)], c=p.case(F.col("a"), [(F.lit(1), "one")])) == [("one",), (None,)]


@pytest.mark.parametrize("pattern,expected", [("*", True), ("user_*", True), ("^user_[a-z]+$", True), ("user_jdoe", True), ("u.er*", False), ("other", False), ("", False), (None, False)])
def test_name_patterns(spark, pattern, expected):
    assert values(spark, "a string", [("user_jdoe",)], m=p.name_matches(F.col("a"), pattern)) == [(expected,)]


def test_tag_query(spark):
    rows = [(["Finance/PII"],), (["finance"],), (["financeother/x"],), (None,)]
    got = values(spark, "t array<string>", rows, space=p.tag_query(F.col("t"), "finance"), exact=p.tag_query(F.col("t"), "FINANCE/pii"))
    assert got == [(True, True), (True, False), (False, False), (False, False)]
