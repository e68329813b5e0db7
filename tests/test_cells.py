"""The stored vector index against the exact search without one."""

import numpy as np

from quarrystone.operators import cells, dense


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<double>")


def same(spark, queries, vectors, k, **options):
    q, v = frame(spark, queries, "qid"), frame(spark, vectors, "vec_id")
    index = cells.VectorIndex.load(spark, cells.build_index(v, **options).path)
    hits, visits = cells.search(q, index, k)
    want = dense.nearest(q, v, k)
    assert sorted(map(tuple, hits.select("qid", "vec_id", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "vec_id", "score", "rank").collect()))
    return index.blocks.count(), {r.qid: r.blocks for r in visits.collect()}


def test_clustered_vectors_leave_most_blocks_unread(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    vectors = np.concatenate([c + 0.05 * r.normal(size=(60, 16)) for c in centres])
    n, visits = same(spark, centres[:8] + 0.02 * r.normal(size=(8, 16)), vectors, 5, cells=20, rows=20)
    assert n >= 60 and len(visits) == 8 and max(visits.values()) < n / 4


def test_any_vectors_give_exact_hits(spark, monkeypatch):
    monkeypatch.setattr(cells, "RINGS", 4)
    monkeypatch.setattr(cells, "QUERIES", 3)
    r = np.random.default_rng(2)
    vectors = np.concatenate([r.normal(size=(150, 4)), np.zeros((12, 4)), np.tile([1.0, 0, 0, 0], (25, 1)), -np.eye(4)])
    queries = np.concatenate([r.normal(size=(5, 4)), np.zeros((1, 4)), np.eye(4)[:1]])
    same(spark, queries, vectors, 7, cells=6, rows=9)
    same(spark, queries, vectors[:3], 7)


def test_no_vectors_and_no_queries(spark):
    v = frame(spark, [], "vec_id")
    index = cells.build_index(v)
    assert cells.search(frame(spark, [[1.0, 2.0]], "qid"), index)[0].collect() == []
    index = cells.build_index(frame(spark, [[1.0, 2.0]], "vec_id"))
    assert cells.search(frame(spark, [], "qid"), index)[0].collect() == []
