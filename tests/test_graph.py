from random import Random

from pyspark.sql import functions as F

from curatrix.operators import graph as g
from curatrix.operators import knowledge as kg
from curatrix.sources import triples as tr


def brute_reach(edges, root):
    depth, frontier, d = {root: 0}, [root], 0
    while frontier:
        d += 1
        frontier = sorted({b for a, b in edges if a in frontier} - set(depth))
        depth.update({n: d for n in frontier})
    return depth


def test_reach_stops_on_cycles_and_gives_least_depth(spark):
    rnd = Random(1)
    edges = {(rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(40)} | {(0, 1), (1, 0)}
    steps = spark.createDataFrame(sorted(edges), "src int, dst int")
    got = {(r.root, r.node): r.depth for r in g.reach(steps, spark.createDataFrame([(0,), (3,)], "root int")).collect()}
    assert got == {(root, n): d for root in (0, 3) for n, d in brute_reach(edges, root).items()}


def test_closure_by_doubling_equals_frontiers_in_few_rounds(spark, monkeypatch):
    rnd = Random(11)
    edges = sorted({(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(70)}) + [(n, n + 1) for n in range(100, 160)] + [(5, 5)]
    steps = spark.createDataFrame(edges, "src int, dst int").distinct()
    rounds, counted = [], g._counted
    monkeypatch.setattr(g, "_counted", lambda *a: rounds.append(1) or counted(*a))
    want = {(root, n): d for root in {a for a, _ in edges} for n, d in brute_reach(edges, root).items()}
    assert {(r.root, r.node): r.depth for r in g.reach(steps).collect()} == want
    assert len(rounds) <= 7  # a chain of 60 steps
    for depth in (0, 1, 3, 4):
        got = [(r.root, r.node, r.depth) for r in g.reach(steps, max_depth=depth).collect()]
        assert sorted(got) == sorted((a, b, d) for (a, b), d in want.items() if d <= depth)
    assert g.reach(steps.limit(0)).count() == 0


def test_reach_is_idempotent_on_a_closure(spark):
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    closure = g.reach(steps, steps.select(F.col("src").alias("root"))).filter("depth > 0").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    again = g.reach(closure, steps.select(F.col("src").alias("root"))).filter("depth > 0").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    assert sorted(map(tuple, closure.collect())) == sorted(map(tuple, again.collect()))


def test_cycle_members(spark):
    parent = {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 8, 8: None, 9: 10, 10: 9}
    refs = spark.createDataFrame(list(parent.items()), "node int, parent int")
    assert sorted(map(tuple, g.cycle_members(refs).collect())) == [(1, 1), (2, 1), (3, 1), (6, 6), (9, 9), (10, 9)]


def test_cycles_through_any_parent(spark):
    refs = spark.createDataFrame([("b", "a"), ("b", "z"), ("z", "b"), ("z", None), ("q", "b")], "node string, parent string")
    assert sorted(map(tuple, g.cycle_members(refs).collect())) == [("b", "b"), ("z", "b")]
    assert sorted(map(tuple, g.cycle_paths(refs).collect())) == [("b", 0, "b"), ("b", 1, "z")]


def test_components_equal_mutual_reachability(spark):
    for seed, nodes, count in ((2, 50, 62),):
        rnd = Random(seed)
        edges = sorted({(rnd.randint(0, nodes), rnd.randint(0, nodes)) for _ in range(count)} | {(100, 101), (101, 102), (102, 100), (103, 100)})
        after = {n: set(brute_reach(edges, n)) for n in {x for e in edges for x in e}}
        loops = {a for a, b in edges if a == b}
        want = {}
        for n in after:
            same = {m for m in after[n] if n in after[m]}
            if len(same) > 1 or n in loops:
                want[n] = min(same)
        got = {r.node: r.component for r in g.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
        assert got == want
        refs = spark.createDataFrame(edges, "node int, parent int")
        paths = {}
        for r in g.cycle_paths(refs).collect():
            paths.setdefault(r.cycle, {})[r.position] = r.node
        for start, path in paths.items():
            walk = [path[i] for i in range(len(path))]
            assert walk[0] == start == min(walk) and all(e in set(edges) for e in zip(walk, [*walk[1:], start]))
        assert {want[c] for c in paths} == set(want.values())


def mutual(edges):
    """Brute force: the smallest node that each node on a cycle shares cycles with."""
    after = {n: set(brute_reach(edges, n)) for n in {x for e in edges for x in e}}
    loops = {a for a, b in edges if a == b}
    same = {n: {m for m in after[n] if n in after[m]} for n in after}
    return {n: min(s) for n, s in same.items() if len(s) > 1 or n in loops}


def test_components_of_merged_nodes_and_of_a_core(spark, monkeypatch):
    def found(edges):
        return {r.node: r.component for r in g.components(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()}

    rnd = Random(11)
    sparse = {(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(55)} | {(i, i) for i in (3, 8)}
    hung = {(50 + i, 50 + i // 3) for i in range(1, 30)} | {(50, 61), (52, 70), (70, 71), (71, 90), (90, 71), (95, 71), (96, 97), (97, 96), (98, 97)}
    dense = {(100 + a, 100 + b) for a in range(9) for b in ((2 * a) % 9, (2 * a + 1) % 9, (a + 4) % 9)} | {(a, 100) for a in range(5)} | {(104, 120), (120, 121), (121, 120), (120, 122), (122, 121)}
    edges = sparse | hung | dense
    assert found(edges) == mutual(edges)
    monkeypatch.setattr(g, "CORE_EDGES", 0)
    assert found(edges) == mutual(edges)


def test_components_rounds_do_not_follow_a_long_path_that_many_enter(spark, monkeypatch):
    n = 120
    knots = {(k + i, j + i) for i in range(n) for k in (1000, 2000, 3000) for j in (1000, 2000, 3000) if j != k}
    edges = {(i, i + 1) for i in range(n)} | knots | {(1000 + i, i) for i in range(n)} | {(40, 20)}
    rounds, settled = [], g.settled

    def counted(*args):
        rounds.append(1)
        assert len(rounds) < n
        return settled(*args)

    monkeypatch.setattr(g, "settled", counted)
    got = {r.node: r.component for r in g.components(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()}
    assert got == {**dict.fromkeys(range(20, 41), 20), **{k + i: 1000 + i for i in range(n) for k in (1000, 2000, 3000)}}


def test_long_chain_and_cycle(spark):
    refs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(200, 150)], "node int, parent int")
    assert sorted(r.node for r in g.cycle_members(refs).collect()) == list(range(150, 201))


def test_propagate_max_is_order_free(spark):
    rnd = Random(5)
    edges = {(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(45)}
    levels = {n: rnd.randint(1, 4) for n in rnd.sample(range(31), 6)}
    want = {}
    for root, lvl in levels.items():
        for first in [b for a, b in edges if a == root]:
            for node in brute_reach(edges, first):
                want[node] = max(want.get(node, 0), lvl)
    got = g.propagate_max(spark.createDataFrame(sorted(edges), "src int, dst int"), spark.createDataFrame(sorted(levels.items()), "node int, level int"))
    assert {r.node: r.inherited for r in got.collect()} == want


def test_propagate_without_levels(spark):
    out = g.propagate_max(spark.createDataFrame([(1, 2)], "src int, dst int"), spark.createDataFrame([(1, None)], "node int, level int"))
    assert out.count() == 0


def test_ntriples_literals_and_blank_nodes(spark):
    lines = [
        '<http://x/a> <http://x/p> "say \\"hi\\"\\n" .', '_:b1 <http://x/p> _:b2 .', '<http://x/a> <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
        '<http://x/a> <http://x/p> "Haus"@de-AT .', "# a comment", "",
    ]
    rows = tr.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"), "urn:g").collect()
    got = {(r.subject, r.object, r.object_is_uri, r.language, r.datatype) for r in rows}
    assert got == {
        ("http://x/a", 'say "hi"\n', False, None, None), ("urn:gov:bnode:urn:g:b1", "urn:gov:bnode:urn:g:b2", True, None, None),
        ("http://x/a", "5", False, None, "http://www.w3.org/2001/XMLSchema#integer"), ("http://x/a", "Haus", False, "de-AT", None)}


def test_ntriples_escapes_comments_and_rejects(spark):
    lines = [r'<a> <p> "x\\ny" .', r'<a> <q> "tab\tcr\r\u00e9\U0001F600" . # a note', "<a> <p> broken .", "  # only a comment", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {r.predicate: r.object for r in tr.parse_ntriples(df, "urn:g").collect()} == {"p": "x\\ny", "q": "tab\tcr\r\u00e9\U0001f600"}
    assert [r.value for r in tr.rejected_ntriples(df).collect()] == ["<a> <p> broken ."]


def test_loading_triples_twice_changes_nothing(spark):
    t = tr.parse_ntriples(spark.createDataFrame([('<a> <p> "x" .',), ('<a> <p> "x" .',), ("<a> <p> <b> .",)], "value string"), "urn:g")
    once = tr.load_triples(t.limit(0), t)
    assert once.count() == 2 and tr.load_triples(once, t).count() == 2


def test_patterns_with_repeated_and_missing_variables(spark):
    t = spark.createDataFrame([("a", "p", "a"), ("a", "p", "b"), ("b", "q", "c")], "subject string, predicate string, object string")
    assert [tuple(r) for r in kg.match_patterns(t, [("?x", "p", "?x")]).collect()] == [("a",)]
    rows = kg.match_patterns(t, [("?x", "p", "?y")], [("?y", "q", "?z")]).select("x", "y", "z").collect()
    assert sorted(map(tuple, rows), key=str) == [("a", "a", None), ("a", "b", "c")]
