import math
import random

import numpy as np

from quarrystone.llm import negatives
from quarrystone.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=100, n_positives=5, n_negatives=10):
    """Rows ``vec_id, embedding, label`` with one row an id, by sorting all scores of an anchor."""
    sound = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows
             if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, alabel in sound:
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in sound if i != a)
        for s, p, _ in [t for t in scores if t[2] == alabel][:n_positives]:
            fits = [(-t, i) for t, i, label in scores if label != alabel and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fits[:n_negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, block int, key string")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert got(QUERIES["op12_hard_negatives"](spark, FOLDER)) == plain(rows)


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ZONES", 3)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.75, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.5], 1) for i in range(60)]
    assert got(negatives.hard_negatives(frame(spark, rows), every=10, rows=8)) == plain(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [0.9, 1.0], 1), (2, [0.5, 0.5], 2), (3, [nan, 1.0], 2), (4, [inf, 0.0], 1), (5, None, 1), (6, [1.0, None], 2), (7, [0.5, 0.4], None), (None, [0.5, 0.5], 2),
            (8, [0.4, 0.5], 3), (100, [-1.0, -1.0], 1), (200, [0.0, 0.0], 2), (9, [0.6], 2)]
    assert got(negatives.hard_negatives(frame(spark, rows))) == plain(rows)
    assert got(negatives.hard_negatives(frame(spark, [*rows, rows[2], rows[0]]))) == plain(rows)
    assert negatives.hard_negatives(frame(spark, rows).limit(0)).collect() == []
    assert negatives.hard_negatives(frame(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).collect() == [(0, 1, 1, 2, 0, 0)]


def test_hilbert_keys_walk_from_neighbour_to_neighbour():
    grid = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    keys = negatives.hilbert_keys(grid, 3)
    walk = grid[np.argsort(np.array(keys, object))]
    assert len(set(keys)) == len(grid)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_zone_maps_rule_blocks_out():
    """Two clusters: a window around the near one reads one block, and no block is ruled out that holds a row of it."""
    near, far = np.array([[90, 90], [100, 95]]), np.array([[-90, 5], [-100, 0]])
    lo, hi = np.stack([near.min(0), far.min(0)]), np.stack([near.max(0), far.max(0)])
    anchor = np.array([[10, 1]])
    down, up = negatives.may_read(anchor, lo, hi)
    for block, box in enumerate((near, far)):
        s = negatives.products(anchor, box)
        assert down[0, block] <= s.min() and s.max() <= up[0, block]
    windows = np.array([[0, 500, 2000, negatives.LEAST]])
    read = negatives.chosen(windows, np.array([1]), np.array([2, 2]), down, up, False, True)
    assert read.tolist() == [[True, False]]
    assert not negatives.chosen(windows, np.array([1]), np.array([2, 2]), down, up, False, False).any()


def test_large_numbers_stay_exact():
    a = np.array([[1 << 25, -(1 << 25) + 1]] * 2)
    assert negatives.products(a, a)[0, 1] == (1 << 50) + ((1 << 25) - 1) ** 2
