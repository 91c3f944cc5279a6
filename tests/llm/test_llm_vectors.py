"""Operators on embeddings against brute force, and their defined cases."""

import numpy as np
import pandas as pd
import pytest

from curatrix.llm import multi_index, vector_dedup
from curatrix.llm.common import table

TYPES = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd(spark, small):
    """The table with exact copies, rows that take no part, a repeated row and clashing columns."""
    base = table(spark, small, "embeddings")
    bad = spark.createDataFrame([(300000, None, 1), (300001, [0.0] * 64, 1), (300050, [float("nan")] * 64, 1), (300100, [], 1), (300150, [1.0, 2.0], 1), (None, [1.0] * 64, 1), (300200, [float("inf")] + [0.0] * 63, 1)], TYPES)
    copies = base.where("vec_id < 40").selectExpr("vec_id + 100000 as vec_id", "embedding", "label")
    twice = base.where("vec_id = 50").selectExpr("vec_id + 400000 as vec_id", "embedding", "label")
    holes = base.where("vec_id between 40 and 44").selectExpr("vec_id + 200000 as vec_id", "transform(embedding, (x, i) -> case when i = 3 then null else x end) as embedding", "label")
    out = base.union(bad).union(copies).union(holes).union(twice).union(twice)
    return out.selectExpr("*", "'clash' as node", "'clash' as h", "'clash' as cell", "'clash' as score").repartition(3)


def taking_part(df):
    found = df.select("vec_id", "embedding").toPandas()
    ok = [v == v and v is not None and x is not None and len(x) == 64 and all(c is not None and np.isfinite(c) for c in x) and any(c != 0 for c in x) for v, x in zip(found.vec_id, found.embedding, strict=True)]
    found = found[ok]
    x = np.array(found.embedding.tolist(), float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return found.vec_id.to_numpy(int), u @ u.T


def test_nearest(odd, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 100)
    ids, cosine = taking_part(odd)
    got = pd.DataFrame([r.asDict() for r in multi_index.nearest(odd, odd.where("vec_id % 50 = 0"), least=300).collect()])
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        own = np.where(ids == ids[i], -9, cosine[i])
        other, first = np.unique(ids, return_index=True)
        best = other[np.lexsort((other, -own[first].round(12)))][:5]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and not set(mine.vec_id) & {ids[i]}
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 5
        assert np.allclose(mine.score, [own[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], atol=1e-12)
    assert hit / total >= 0.9
    assert set(got.query_id) <= set(ids)


def test_nearest_small_tables(spark):
    few = spark.createDataFrame([(50, [1.0, 0.0, 0.5], 0), (1, [0.9, 0.1, 0.4], 0), (2, [0.9, 0.1, 0.4], 0)], TYPES)
    got = [(r.query_id, r["rank"], r.vec_id) for r in multi_index.nearest(few, few.where("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(50, 1, 1), (50, 2, 2)]
    assert multi_index.nearest(few.limit(0), few.limit(0)).count() == 0
    assert multi_index.nearest(few.where("vec_id = 50"), few.where("vec_id = 50")).count() == 0


@pytest.mark.parametrize("tile", [64, 4096])
def test_near_vectors(odd, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    ids, cosine = taking_part(odd)
    near = cosine >= 0.9
    np.fill_diagonal(near, False)
    up = {int(i): int(i) for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
        up[b] = a
    got = pd.DataFrame([r.asDict() for r in vector_dedup.near_vectors(odd).collect()])
    assert len(got) == odd.count()
    links = dict(zip(ids.tolist(), near.sum(1).tolist(), strict=True))
    for r in got.itertuples():
        if r.vec_id in links:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], find(int(r.vec_id)), r.vec_id == find(int(r.vec_id)))
        else:
            assert r.n_links == 0 and (r.vec_id != r.vec_id or (r.component_id == r.vec_id and r.kept))


def test_near_vectors_empty(odd):
    assert vector_dedup.near_vectors(odd.limit(0)).count() == 0
    assert vector_dedup.near_vectors(odd.where("embedding is null")).collect()[0].kept


def test_links_keep_every_component():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 40))
    x = np.repeat(base, 30, axis=0) + rng.normal(scale=0.28, size=(180, 40))
    rotated = vector_dedup.unit(x) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    want = np.triu(vector_dedup.unit(x) @ vector_dedup.unit(x).T >= 0.9, 1)
    forest, seen = vector_dedup.Forest(180), np.zeros((180, 180), bool)
    for i, j in vector_dedup.linked(x, x, rotated, rotated, 0.9, True, strip=7):
        seen[i, j] = True
        forest.add(i, j)
    assert (seen == want).all()
    plain = vector_dedup.Forest(180)
    plain.add(*np.nonzero(want))
    assert [forest.find(i) for i in range(180)] == [plain.find(i) for i in range(180)]


def test_every_length_of_vector_is_compared(spark):
    short = [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (150, [1.0, 2.1])]
    long = [(i, [1.0, float(i), 0.5]) for i in range(5)]
    docs = spark.createDataFrame(short + long + [(7, None), (8, [0.0, 0.0])], "vec_id long, embedding array<double>")
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(docs).collect()}
    assert links[100] == links[101] == links[150] == (2, 100) and links[7] == (0, 7) and links[8] == (0, 8) and len(links) == 10
    found = multi_index.nearest(docs, docs.where("vec_id in (150, 0)")).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 150] == [100, 101]
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 0) == [1, 2, 3, 4]
