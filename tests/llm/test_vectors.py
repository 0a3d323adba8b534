import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provlake.llm import neighbours, topk, vectors


def cloud(n=900, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, dim))
    rows = (centres[rnd.integers(0, 12, n)] + 0.4 * rnd.standard_normal((n, dim))).astype(np.float32)
    rows[50:80] = rows[50]  # many of one vector: ties
    return rows


def brute(rows, q, score, k):
    ids = np.arange(len(rows))
    s = score(rows, rows[q]).astype(float)
    s[q] = np.inf
    return [(int(i), s[i]) for i in np.lexsort((ids, s))[:k]]


def distance(rows, q):
    return np.sqrt(((rows.astype(float) - q.astype(float)) ** 2).sum(axis=1))


def negative_product(rows, q):
    f = lambda x: np.floor(256 * x.astype(float))
    return -(f(rows) @ f(q))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(cloud())], "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("queries, shard", [(4096, 8192), (8, 100)])
def test_recall(spark, frame, monkeypatch, queries, shard):
    monkeypatch.setattr(vectors, "QUERIES", queries)  # 8: several blocks of queries
    monkeypatch.setattr(vectors, "SHARD", shard)
    rows, got, hit = cloud(), {}, 0
    for r in neighbours.nearest(frame, F.col("id") % 30 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 30))
    for q, found in got.items():
        want = brute(rows, q, distance, 10)
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11)) and all(f[2] == distance(rows, rows[q])[f[1]] for f in found)
        hit += len({f[1] for f in found} & {w[0] for w in want})
    assert hit >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("queries, shard", [(4096, 8192), (8, 100)])
def test_exact_products(spark, frame, monkeypatch, queries, shard):
    monkeypatch.setattr(vectors, "QUERIES", queries)
    monkeypatch.setattr(vectors, "SHARD", shard)
    rows = cloud()
    got = sorted(tuple(r) for r in topk.top_products(frame, F.col("id") % 50 == 0).collect())
    want = [(q, k + 1, i, int(-s)) for q in range(0, 900, 50) for k, (i, s) in enumerate(brute(rows, q, negative_product, 5))]
    assert got == want


def tables():
    return [t for t in ("sf0.001", "sf0.01", "sf0.1", "check_s") if os.path.exists(f"/root/testdata/{t}/embeddings.parquet")]


def embeddings(name):
    import pyarrow.parquet as pq

    table = pq.read_table(f"/root/testdata/{name}/embeddings.parquet", columns=["vec_id", "embedding"])
    return np.array(table["vec_id"].to_pylist()), np.array(table["embedding"].to_pylist(), dtype=float)


@pytest.mark.parametrize("name", tables())
def test_neighbours_of_the_test_tables(name):
    """Recall against brute force, and the share of vectors whose distance is computed."""
    ids, rows = embeddings(name)
    asked = np.flatnonzero(ids % 100 == 0)[:100]
    got, verified = neighbours.search_shard(vectors.unpacked(neighbours.make_index(ids, rows)), ids[asked], rows[asked], 10)
    hit = total = 0
    for q in asked:
        d = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        d[ids == ids[q]] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit += len(want & set(got.loc[got["query_id"] == ids[q], "vec_id"]))
        total += len(want)
    assert hit >= 0.98 * total
    assert len(rows) < 1_000 or verified < 0.25 * len(asked) * len(rows)


@pytest.mark.parametrize("name", tables())
def test_products_of_the_test_tables(name):
    """Exact, with most candidates ruled out by the bounds."""
    ids, rows = embeddings(name)
    scaled = np.floor(256 * rows)
    pivots = topk.choose_pivots(scaled[:1024])
    asked = np.flatnonzero(ids % 50 == 0)[:100]
    got, evaluated = topk.search_shard(vectors.unpacked(topk.make_index(ids, rows, pivots, 256.0)), ids[asked], rows[asked], pivots, 256.0, 5)
    for q in asked:
        s = scaled @ scaled[q]
        s[ids == ids[q]] = -np.inf
        best = np.lexsort((ids, -s))[:5]
        mine = got[got["query_id"] == ids[q]]
        assert list(zip(mine["vec_id"], mine["score"])) == [(ids[b], int(s[b])) for b in best]
    assert len(rows) < 1_000 or evaluated < 0.15 * len(asked) * len(rows)


def test_bound_is_never_too_low():
    rnd = np.random.default_rng(3)
    for dim, scale in ((2, 1.0), (5, 1e3), (16, 1e6), (64, 300.0)):
        rows = np.floor(scale * rnd.standard_normal((300, dim)))
        rows[:40] = rows[0] * rnd.integers(1, 4, 40)[:, None]
        pivots = topk.choose_pivots(rows[:100])
        norms = (rows**2).sum(axis=1)
        at, rest = topk.places(topk.to_pivots(rows, pivots), norms, pivots)
        upper = at @ at.T + np.outer(rest, rest) + 1e-9 * 2 * norms.max() + 1e-6
        assert (upper >= rows @ rows.T).all()
        # Never above what the plain form, the greatest difference of distances to one pivot, allows.
        table = topk.to_pivots(rows, pivots)
        plain = np.abs(table[:, None] - table[None]).max(axis=2)
        assert (upper <= (norms[:, None] + norms[None] - plain**2) / 2 + 1e-5 * norms.max() + 1e-3).all()


def test_best_breaks_ties_by_id():
    rnd = random.Random(1)
    ids = np.array(rnd.sample(range(1000), 200))
    scores = np.array([rnd.randint(0, 3) for _ in ids], float)
    assert list(vectors.best(ids, scores, 7)) == sorted(range(200), key=lambda k: (scores[k], ids[k]))[:7]


def test_large_products_are_exact():
    rows = np.array([[2.0**30, 3.0], [2.0**30, 5.0]])
    assert list(topk._products(rows, np.array([2.0**30, 1.0]))) == [2**60 + 3, 2**60 + 5]


def test_products_beyond_a_long(spark):
    """Ranks are those of the exact products; what no long holds is the nearest long."""
    values = {0: [1e10, 1e10], 1: [1e10, 1.0], 2: [2e10, 1e10], 3: [-1e10, -1e10], 4: [-3e10, -1e10], 5: [1.0, 2.0], 6: [1e307, -1e307], 7: [0.0, 0.0]}
    df = spark.createDataFrame([(k, v) for k, v in values.items()] + [(None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    exact = {k: topk.whole(np.array(v), 256.0) for k, v in values.items()}
    got = [tuple(r) for r in topk.top_products(df, F.lit(True), k=9).orderBy("query_id", "rank").collect()]
    want = []
    for q in values:
        scored = sorted(((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in values if i != q))
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored)]
    assert got == want


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [None, 1.0]), (500, [float("nan"), 1.0]), (600, [1.0]), (1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, schema)
    assert sorted(tuple(r) for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect()) == [(100, 1, 1, pytest.approx(20**0.5))]
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("id") % 50 == 0).collect())
    assert got == [(100, 1, 1, 256 * 768), (100, 2, 200, 0), (200, 1, 1, 0), (200, 2, 100, 0), (200, 3, 100, 0)]
    for search in (neighbours.nearest, topk.top_products):
        assert search(spark.createDataFrame([], schema), F.lit(True)).collect() == []
        assert search(spark.createDataFrame([(1, None)], schema), F.lit(True)).collect() == []
