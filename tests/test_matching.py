import random

import pytest
from hypothesis import given
from hypothesis import strategies as hs

from curatrix.functions.similarity import _indel, _jaro_winkler, _partial
from curatrix.operators import matching as mt
from curatrix.operators.matching import MatchRule
from pyspark.sql import functions as F

RULES = [MatchRule("email", "exact", ("email",), 0.5, 0.7), MatchRule("phone", "deterministic", ("phone",), 0.3, 0.7), MatchRule("name", "fuzzy", ("name",), 0.2, 0.7)]
MASTER = [(i, f"name{i % 7}", "hot@x.org" if i % 3 == 0 else f"u{i % 11}@x.org", f"555-{1000000 + i % 9}") for i in range(60)]
SOURCE = [(1000 + i, f"nam{i % 7}e", " HOT@x.org" if i % 3 == 0 else f"U{i % 13}@X.org ", None if i % 8 == 0 else f"+1 555 {1000000 + i % 10}") for i in range(60)]


def digits7(p):
    return None if p is None else "".join(c for c in p if c.isdigit())[-7:]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute():
    out = set()
    for mi, mn, me, mp in MASTER:
        for si, sn, se, sp in SOURCE:
            score = 0.5 * (me.strip().lower() == se.strip().lower()) + 0.3 * (sp is not None and digits7(mp) == digits7(sp)) + 0.2 * (1 - lev(mn, sn) / max(len(mn), len(sn)))
            if score >= 0.7 - 1e-9:
                out.add((mi, si))
    return out


def test_rule_blocks_lose_nothing_against_all_pairs(spark):
    cols = "id int, name string, email string, phone string"
    m, mm = mt.profiles(spark.createDataFrame(MASTER, cols), ["name", "email", "phone"], "id")
    s, sm = mt.profiles(spark.createDataFrame(SOURCE, cols), ["name", "email", "phone"], "id")
    matches = mt.find_matches(m, s, RULES)
    got = {(r.master_id, r.source_id) for r in mt.expand_matches(matches, mm, sm).collect()}
    assert got == brute()
    candidates = mt.best_candidates(matches, sm)
    assert candidates.count() == len(SOURCE)
    assert {r.source_id for r in candidates.filter("match_type <> 'new'").collect()} == {b for _, b in brute()}


@pytest.mark.parametrize("threshold", [0.2, 0.15])
def test_mixed_rules_lose_nothing_where_text_reaches_the_threshold_alone(spark, threshold):
    cols = "id int, name string, email string, phone string"
    left = [(1, "anna", "a@x.org", "555-1000001"), (2, "bert", "b@x.org", "555-1000002"), (3, "carola", "c@x.org", None)]
    right = [(11, "zzzz", "A@x.org", "555-2000000"), (12, "qqqq", "q@x.org", "+1 555 1000002"), (13, "carole", "d@x.org", None), (14, "carola", "e@x.org", None), (15, "vvvv", "v@x.org", None)]
    rules = [MatchRule(r.name, r.kind, r.fields, r.weight, threshold) for r in RULES]
    m, mm = mt.profiles(spark.createDataFrame(left, cols), ["name", "email", "phone"], "id")
    s, sm = mt.profiles(spark.createDataFrame(right, cols), ["name", "email", "phone"], "id")
    got = sorted((r.master_id, r.source_id) for r in mt.expand_matches(mt.find_matches(m, s, rules), mm, sm).collect())
    score = lambda a, b: 0.5 * (a[2].lower() == b[2].lower()) + 0.3 * (None not in (a[3], b[3]) and digits7(a[3]) == digits7(b[3])) + 0.2 * (1 - lev(a[1], b[1]) / max(len(a[1]), len(b[1])))
    want = sorted((a[0], b[0]) for a in left for b in right if score(a, b) >= threshold - 1e-9)
    assert got == want and {(1, 11), (2, 12), (3, 14)} <= set(want)


def test_minimal_blocks():
    names = [tuple(r.name for r in g) for g in mt.minimal_blocks(RULES, 0.7)]
    assert names == [("email",)]
    assert mt.minimal_blocks(RULES, 0.2) == [()]
    assert mt.text_floor(RULES, 0.7) is None and mt.text_floor(RULES, 0.2) == pytest.approx(1.0)


def test_text_pairs_miss_nothing(spark):
    words = ["", "a", "ab", "abcd", "abdc", "abcdefgh", "abcdefgx", "xbcdefgh", "abcdfgh", "abcdefghij", "zzabcdefgh", "ABCDEFGH", "kitten sitting", "sitting kitten", "kittens sitting"]
    df = spark.createDataFrame([(w,) for w in words], "name string").selectExpr("name as profile", "name")
    for floor in (0.5, 0.75, 0.9):
        got = {(r.m_profile, r.s_profile) for r in mt.text_pairs(df, df, "name", floor).collect()}
        want = {(a, b) for a in words for b in words if a and b and 1 - lev(a.lower(), b.lower()) / max(len(a), len(b)) >= floor}
        assert want <= got


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


RATIOS = {
    "ratio": lambda a, b: 1 - lev(a.lower(), b.lower()) / max(len(a), len(b)),
    "indel": lambda a, b: 2 * lcs(a.lower(), b.lower()) / (len(a) + len(b)),
    "token_sort": lambda a, b: RATIOS["ratio"](*(" ".join(sorted(t.lower().split())) for t in (a, b))),
}


@pytest.mark.parametrize("algorithm", sorted(RATIOS))
def test_prefixes_of_grams_miss_nothing_between_edited_names(spark, algorithm):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(60)]

    def edited(t):
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(t))
            t = rng.choice([t[:i] + rng.choice("abcd") + t[i:], t[:i] + t[i + 1 :], t[:i] + "b" + t[i + 1 :]])
        return t.strip() or "a"

    frame = lambda rows: spark.createDataFrame([(r,) for r in sorted(set(rows))], "name string").selectExpr("name as profile", "name")
    left, right = names, [edited(t) for t in names for _ in range(2)]
    for floor in (0.3, 0.5, 0.6, 2 / 3, 0.75, 0.8, 0.95, 1.0):
        got = {(r.m_profile, r.s_profile) for r in mt.text_pairs(frame(left), frame(right), "name", floor, algorithm).collect()}
        want = {(a, b) for a in left for b in right if RATIOS[algorithm](a, b) >= floor - 1e-9}
        assert want <= got, floor


def test_few_candidates_among_names(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    words = [word() for _ in range(300)]
    names = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(1500)})
    df = spark.createDataFrame([(n,) for n in names], "name string").selectExpr("name as profile", "name")
    assert mt.text_pairs(df, df, "name", 0.8).count() < 0.01 * len(names) ** 2
    assert mt.gram_length(0.8) == 3 and mt.gram_length(0.6) == 2 and mt.gram_length(0.4) == 1 and mt.gram_length(0.8, "indel") == 3


def test_a_floor_of_zero_is_refused(spark):
    df = spark.createDataFrame([("a", "a")], "profile string, name string")
    with pytest.raises(ValueError):
        mt.text_pairs(df, df, "name", 0.0)


@given(hs.text("abcé ", max_size=12), hs.text("abcé ", max_size=12))
def test_indel_and_its_best_window(a, b):
    assert _indel(a, b) == (2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)
    s, t = sorted((a, b), key=len)
    windows = [t[i : i + len(s)] for i in range(len(t) - len(s) + 1)]
    assert _partial(a, b) == (max(lcs(s, w) / len(s) for w in windows) if s else 0.0)


def test_source_columns_take_the_masters_names(spark):
    df = spark.createDataFrame([(1, "a", "b")], "Id int, Mail string, x string")
    assert [tuple(r) for r in mt.with_master_columns(df, {"mail": "email"}, ["id", "email", "phone"]).collect()] == [(1, "a", None)]


def test_rules_without_known_columns_do_not_count():
    used = mt.applicable([*RULES, MatchRule("ghost", "exact", ("zz",), 9.0)], ["email", "phone", "name"])
    assert [r.name for r in used] == ["email", "phone", "name"]


@pytest.mark.parametrize("strategy,expected", [("source_wins", "s"), ("most_recent", "s"), ("master_wins", "master"), ("most_complete", "master")])
def test_survivorship(spark, strategy, expected):
    df = spark.createDataFrame([("master", "s"), ("master", ""), ("master", None), (None, "s")], "m_f string, s_f string")
    rows = [r[0] for r in df.select(mt.survive(F.col("m_f"), F.col("s_f"), strategy)).collect()]
    assert rows == [expected, "master", "master", "s"]


def test_jaro_winkler_known_values():
    assert round(_jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(_jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert _jaro_winkler("", "a") == 0.0


def test_pairs_of_a_profile_with_many_copies_are_spread(spark):
    rows = lambda first: spark.sql(f"SELECT id + {first} AS id, CASE WHEN id < 300 THEN 'Desk' ELSE concat('n', id) END AS name FROM range(400)")
    (m, mm), (s, sm) = (mt.profiles(rows(x), ["name"], "id") for x in (0, 5000))
    found = mt.find_matches(m, s, [MatchRule("name", "exact", ("name",), 1.0, 1.0)])
    out = mt.pair_candidates(found, rows(0), rows(5000), mm, sm, "id")
    assert out.count() == 300 * 300 + 100
    assert out.filter("get_json_object(master_record, '$.id') <> master_id OR get_json_object(source_record, '$.id') <> source_id").count() == 0
    shown = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in shown.splitlines() if "Join" in line and "_profile" in line]
    assert sum("_number" in line for line in joins) == 2 and not any("Broadcast" in line for line in joins if "_number" in line)


def copies(spark, n, first):
    return spark.sql(f"SELECT id + {first} AS id, CASE WHEN id < {n} THEN 'Desk' WHEN id < {n} + 20 THEN 'Few' ELSE concat('n', id) END AS name FROM range({n} + 50)")


def test_tiles_of_copies_make_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(mt, "TILE", 100)
    monkeypatch.setattr(mt, "RUN", 8)
    master, source = copies(spark, 330, 0).unionByName(copies(spark, 330, 0).filter("id = 7")), copies(spark, 250, 5000)
    (m, mm), (s, sm) = (mt.profiles(df, ["name"], "id") for df in (master, source))
    out = mt.expand_matches(mt.find_matches(m, s, [MatchRule("name", "exact", ("name",), 1.0, 1.0)]), mm, sm)
    names = lambda df: [(r.name, r.id) for r in df.collect()]
    assert sorted((r.master_id, r.source_id) for r in out.collect()) == sorted((i, j) for a, i in names(master) for b, j in names(source) if a == b)


def test_neighbouring_pairs_of_many_copies_name_few_records(spark):
    (m, mm), (s, sm) = (mt.profiles(copies(spark, 700, x), ["name"], "id") for x in (0, 5000))
    found = mt.find_matches(m, s, [MatchRule("name", "exact", ("name",), 1.0, 1.0)])
    out = mt.pair_candidates(found, copies(spark, 700, 0), copies(spark, 700, 5000), mm, sm, "id")
    ids = out.filter("get_json_object(master_record, '$.name') = 'Desk'").select("master_id", "source_id", F.floor(F.monotonically_increasing_id() / 4096).alias("stretch"))
    seen = ids.groupBy("stretch").agg(F.count_distinct("master_id").alias("masters"), F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in seen) == 700 * 700
    assert all(r.masters <= 128 and r.sources <= 2 + r.n / 28 for r in seen if r.n > 1000)
