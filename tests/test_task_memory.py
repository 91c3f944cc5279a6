"""What a task holds: forms that keep it small, and the results they must not change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from curatrix.operators import knowledge as kg
from curatrix.operators import lineage as ln
from curatrix.operators import skew
from curatrix.sources import triples as tr

TRIPLE = "subject string, predicate string, object string, object_is_uri boolean, language string, datatype string, context string"


def triple(s, p, o, context="urn:glossary:c1"):
    return (s, p, o, False, None, None, context)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deletes_are_one_join_over_all_frames_of_triples(spark):
    rows = [triple("http://x/a", tr.RDFS + "label", "A"), triple("http://x/a", tr.GOV + "status", "draft"), triple("http://x/b", tr.RDFS + "label", "B"), triple("http://x/b", tr.GOV + "status", "active"),
            triple("http://x/c", tr.RDFS + "label", "C"), triple("http://x/c", tr.RDFS + "label", "C"), triple("http://x/d", tr.RDFS + "label", "D")]
    triples = reduce(DataFrame.unionByName, [spark.createDataFrame([r], TRIPLE) for r in rows])
    requests = spark.createDataFrame([(f"http://x/{c}", t) for c, t in (("a", "urn:t"), ("a", "urn:u"), ("b", "urn:t"), ("c", "urn:t"), ("d", "urn:shut"))], "concept_iri string, target_iri string")
    homes = spark.createDataFrame([("urn:t", True), ("urn:u", True), ("urn:shut", False)], "iri string, is_editable boolean")
    _, deletes, _ = kg.move_concepts(triples, requests, homes, "migrated", "2024")
    assert sorted((r.subject[-1], r.object) for r in deletes.collect()) == [("a", "A"), ("a", "draft"), ("b", "active"), ("c", "C")]
    assert plan(deletes).count("Join ") == 1
    _, deletes, _ = kg.move_concepts(triples, requests, homes, "promoted", "2024")
    assert sorted((r.subject[-1], r.object) for r in deletes.collect()) == [("a", "draft"), ("b", "active")]


def test_active_triples_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 2)
    rows = [triple(f"http://x/{i % 90}", "urn:p", "o") for i in range(100)] + [triple("http://x/off", "urn:p", "o", "urn:off")]
    off = spark.createDataFrame([("urn:off",)], "context string")
    links = spark.createDataFrame([("t", 1, "http://x/1")] * 2, "entity_type string, entity_id long, iri string")
    out = tr.active_triples(spark.createDataFrame(rows, TRIPLE), off, links)
    assert out.count() == 91 and out.filter("subject = 'http://x/off'").count() == 0
    assert "RepartitionByExpression" in plan(out)
    assert skew.spread_by_rows(spark.range(100), ["id"]).rdd.getNumPartitions() == 50


def test_product_hierarchy_sorts_the_datasets_once(spark):
    rows = [(1, "hasDataset", 10), (1, "hasDataset", 11), (1, "hasDataset", 12), (2, "hasDataset", 10), (2, "hasDataset", None), (2, "hasDataset", 13),
            (10, "hasTable", 100), (10, "hasTable", 100), (10, "governedBy", 7), (11, "governedBy", 7), (11, "governedBy", 8), (13, "hasTable", None), (None, "governedBy", 9), (100, "hasColumn", 5), (100, "hasColumn", 6)]
    out = ln.product_hierarchy(spark.createDataFrame(rows, "source_id long, relationship_type string, target_id long"))
    want = [("path", p, 10, 100, c, None) for p in (1, 2) for c in (5, 6)] + [("path", 1, 11, None, None, None), ("path", 1, 12, None, None, None), ("path", 2, None, None, None, None), ("path", 2, 13, None, None, None)]
    want += [("contract", 1, 10, None, None, 7), ("contract", 2, 10, None, None, 7), ("contract", 1, 11, None, None, 7), ("contract", 1, 11, None, None, 8)]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert plan(out).count("= hasDataset") == 1


def test_shape_checks_join_only_values_along_their_paths(spark):
    rows = [triple("a", tr.RDF + "type", "T"), triple("a", "urn:p", "5"), triple("a", "urn:p", "x"), triple("a", "urn:p", None), triple("a", "urn:q", "99"), triple("b", tr.RDF + "type", "T"), triple("b", "urn:q", "1")]
    shapes = spark.createDataFrame([("s", "T", "urn:p", 1, "^[0-9]+$", 6.0, 40.0)], "shape string, target_class string, path string, min_count int, pattern string, min_inclusive double, max_inclusive double")
    out = kg.shape_checks(spark.createDataFrame(rows, TRIPLE), shapes)
    assert sorted(map(tuple, out.collect())) == sorted([
        ("s", "a", "min_inclusive", "5"), ("s", "a", "pattern", "x"), ("s", "a", "min_inclusive", "x"), ("s", "a", "max_inclusive", "x"), ("s", "b", "min_count", "0")])
    assert "strategy=broadcast" in plan(out)
