import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbase.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """All pairs of scores; rows of (vec_id, label, list of integers)."""
    named = {}
    for i, label, q in rows:
        named[i] = min(named.get(i, (label, q)), (label, q))
    wide = max((len(q) for _, q in named.values()), default=0)
    named = {i: (label, list(q) + [0] * (wide - len(q))) for i, (label, q) in named.items()}
    out = []
    for a, (label, q) in named.items():
        if not is_anchor(a):
            continue
        s = sorted(((-sum(x * y for x, y in zip(q, r, strict=True)), i, other == label) for i, (other, r) in named.items() if i != a))
        for ps, p, _ in [x for x in s if x[2]][:positives]:
            fit = [(x, i) for x, i, same in s if not same and low * -ps <= 100 * -x <= high * -ps]
            out += [(a, p, r + 1, i, -ps, -x) for r, (x, i) in enumerate(fit[:negatives])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, q array<long>")


def mined(df, every=3, **more):
    return sorted(tuple(r) for r in N.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def made(rng, n, dims, spread, labels=4):
    centers = rng.integers(-spread, spread + 1, (6, dims))
    return [(i, int(rng.integers(labels)), [int(x) for x in centers[rng.integers(6)] + rng.integers(-3, 4, dims)]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for name, size in (("BLOCK", 40), ("ANCHORS", 20), ("LANE", 2), ("LEAF", 4)):  # several cells, blocks, lanes and levels
        monkeypatch.setattr(N, name, size)
    rows = made(rng, 500, 6, 30)
    assert mined(frame(spark, rows)) == brute(rows, lambda i: i % 3 == 0) != []
    assert mined(frame(spark, rows), every=7, positives=2, negatives=4, low=20, high=80) == brute(rows, lambda i: i % 7 == 0, 2, 4, 20, 80)


def test_ties_copies_lengths_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), [int(x) for x in rng.integers(-1, 3, 3)]) for i in range(120)]  # few distinct scores
    rows += [(200 + i, 1, [2, 2, 2]) for i in range(90)] + [(400 + i, 2, [2, 2, 1]) for i in range(60)]  # large groups of copies
    rows += [(600, 1, []), (601, 2, [3]), (603, 0, [0, 0, 0])]  # vectors of other lengths, a zero vector
    rows += rows[:20] + [(3, 2, [9, 9, 9]), (3, 0, [9, 9, 9])]  # repeated rows, one id with several vectors
    df = frame(spark, rows)
    for given in (df, df.withColumn("cid", F.lit("x")).withColumn("part", F.lit("y")).withColumn("ids", F.lit(1)).repartition(5)):
        assert mined(given) == brute(rows, lambda i: i % 3 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), [int(x) for x in rng.integers(1 << 29, 1 << 30, 4)]) for i in range(60)]
    assert mined(frame(spark, rows), low=0, high=100) == brute(rows, lambda i: i % 3 == 0, low=0, high=100)
    rows = [(i, int(rng.integers(2)), [int(x) << 31, 1]) for i, x in enumerate(rng.integers(-3, 4, 60))]  # 64-bit components
    assert mined(frame(spark, [(i, label, [q[0] >> 3, q[1]]) for i, label, q in rows])) == brute([(i, label, [q[0] >> 3, q[1]]) for i, label, q in rows], lambda i: i % 3 == 0)


@pytest.mark.parametrize("rows", [[], [(0, 1, [1, 2])], [(1, 1, [1, 2]), (2, 2, [2, 1])], [(0, 1, [1]), (3, 1, [1]), (6, 1, [2])]])
def test_empty_and_without_partners(spark, rows):
    assert mined(frame(spark, rows)) == brute(rows, lambda i: i % 3 == 0) == []


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [0.5, -0.001]), (2, None, [0.5]), (3, 1, None), (4, 1, [0.5, None]), (5, 1, [nan]), (6, 1, [inf]), (7, 1, [-inf, 1.0]), (None, 1, [1.0]), (8, 1, [])]
    got = {r.vec_id: (r.label, r.q) for r in N.quantized(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, [128, -1]), 8: (1, [])}


def test_intervals_hold_every_pair():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(70, 5)) * 50, rng.normal(size=(130, 5)) * 50
    a, b = N.levels_of(x, np.zeros(70, int), np.arange(0, 70, 9)), N.levels_of(y, np.zeros(130, int), np.arange(0, 130, 20))
    for p in a:
        for q in b:
            low, high = N.interval(p.centers, p.norms, p.radii, q.centers, q.norms, q.radii)
            s = x @ y.T
            s = np.minimum.reduceat(np.minimum.reduceat(s, p.starts, 0), q.starts, 1), np.maximum.reduceat(np.maximum.reduceat(s, p.starts, 0), q.starts, 1)
            assert (low <= s[0]).all() and (s[1] <= high).all()


def _row(cids, labels, vectors, low=-N._FAR, high=N._FAR):
    order, leaves = N.tree_order(vectors, labels)
    n = len(order)
    held = np.column_stack([np.ones(n, np.int64), cids[order], np.zeros((n, 5), np.int64)])
    one = lambda v: np.full((n, 1), v, np.int64).tobytes()
    return {"name": "0", "n": n, "cids": cids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": N._packed(vectors[order]), "ids": held.tobytes(), "lows": one(low), "highs": one(high), "marks": one(0), "leaves": leaves.tobytes()}


def test_groups_are_pruned_at_once():
    """Directions that are apart: most leaf pairs are never scored, and the result is that of all pairs."""
    rng = np.random.default_rng(7)
    centers = np.eye(8, dtype=np.int64) * 1000
    of = rng.integers(8, size=8000)
    vectors = centers[of] + rng.integers(-20, 21, (8000, 8))
    labels, ids = rng.integers(2, size=8000), np.arange(8000)
    search = N.Search(_row(ids[:1000], labels[:1000], vectors[:1000]), 6, 6, True)
    for i in range(0, 8000, 4000):
        search.meet(N.Rows(_row(ids[i : i + 4000], labels[i : i + 4000], vectors[i : i + 4000]), 6))
    got = search.result().to_pydict()
    best = {}
    for a, s, i in zip(got["gid"], got["score"], got["ids"], strict=True):
        best.setdefault(a, []).append((-s, i[0]))
    s = vectors[:1000] @ vectors.T
    for a in range(0, 1000, 9):
        assert best[a] == sorted((-int(s[a, i]), i) for i in range(8000) if labels[i] == labels[a])[:6]
    assert search.scored < 0.2 * s.size
