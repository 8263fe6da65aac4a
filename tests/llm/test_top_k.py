import numpy as np
import pytest

from deltaweave.llm import top_k as T


def brute(rows, k):
    out = set()
    for i, v in rows:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)[:k]
        out |= {(i, j, n + 1, round(d, 9)) for n, (d, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("kind", ["clusters", "ties", "line"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(T, "RING", 1 << 10)
    rng = np.random.default_rng(8)
    if kind == "clusters":
        x = rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] * 4 + rng.normal(size=(300, 8)) * 0.3
    elif kind == "ties":
        x = rng.integers(0, 3, (300, 3)).astype(float)  # many equal vectors and distances
    else:
        x = np.arange(150.0)[:, None]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r.vec_id, r.neighbour_id, r.rank, round(r.distance, 9)) for r in T.top_k(df, k=7, pivots=9).collect()}
    assert got == brute(rows, 7)


def test_rings_are_left_out():
    """The bounds do leave out cells: fewer vectors are compared than there are."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 6)) * 50
    x = centres[np.arange(2000) % 20] + rng.normal(size=(2000, 6))
    cell = T.squared(x, centres).argmin(1)
    dist = np.sqrt(((x - centres[cell]) ** 2).sum(1))
    asked = []

    class Cells:
        def rings(self, c):
            d = np.sort(dist[cell == c])
            return [(d[i], d[min(i + 9, len(d) - 1)], (c, i)) for i in range(0, len(d), 10)]

        def ring(self, key):
            asked.append(key[0])
            m = np.flatnonzero(cell == key[0])
            m = m[np.argsort(dist[m])][key[1] : key[1] + 10]
            return m, x[m], x[m].astype(np.float32)

    low, high = (np.array([f(dist[cell == c]) for c in range(20)]) for f in (np.min, np.max))
    m = np.flatnonzero(cell == 3)[:50]
    T.search(x[m], m, centres, low, high, Cells(), 5)
    assert set(asked) == {3}


def test_cost_of_clustered_vectors_grows_below_the_square(spark):
    """Comparisons over a tenfold range: with clusters as fine as the pivots at most n ** 1.5, of which the pivots are one."""
    import math

    done = []
    for n in (2000, 20_000):
        rng = np.random.default_rng(4)
        c = rng.normal(size=(n // 50, 4)) * 200
        x = c[np.arange(n) % len(c)] + rng.normal(size=(n, 4)) * 0.5
        p = x[rng.choice(n, math.isqrt(n), replace=False)]
        cell = T.squared(x, p).argmin(1)
        dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
        order = np.lexsort((dist, cell))
        bounds = np.searchsorted(cell[order], np.arange(len(p) + 1))
        compared = 0

        class Cells:
            def rings(self, k):
                m = order[bounds[k] : bounds[k + 1]]
                return [(dist[m[i]], dist[m[min(i + 63, len(m) - 1)]], m[i : i + 64]) for i in range(0, len(m), 64)]

            def ring(self, m):
                return m, x[m], x[m].astype(np.float32)

        plain = T.Best.offer

        def offer(self, rows, ids, *v):
            nonlocal compared
            compared += len(rows) * len(ids)
            plain(self, rows, ids, *v)

        T.Best.offer = offer
        try:
            low, high = (np.array([f(dist[cell == k]) if (cell == k).any() else np.nan for k in range(len(p))]) for f in (np.min, np.max))
            for i in range(0, n, 64):
                m = order[i : i + 64]
                T.search(x[m], m, p, low, high, Cells(), 10)
        finally:
            T.Best.offer = plain
        done.append(compared + n * len(p))
    assert done[1] <= done[0] * 10**1.5


def test_far_from_the_origin(spark):
    """Single precision can't tell these vectors apart; the result is exact all the same."""
    rng = np.random.default_rng(5)
    for scale, shift in ((1.0, 1e6), (1e-3, 1e3), (1e25, 0.0)):
        x = rng.normal(size=(200, 3)) * scale + shift
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = {(r.vec_id, r.neighbour_id) for r in T.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=4).collect()}
        assert got == {(i, j) for i, j, *_ in brute(rows, 4)}


def test_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (None, [1.0, 1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.neighbour_id, r.rank, r.distance) for r in T.top_k(df.selectExpr("*", "1 as cell", "2 as dist", "3 as vec"), k=3).collect())
    assert got == sorted([(1, 2, 1, 5.0), (1, 2, 2, 5.0), (2, 1, 1, 5.0), (2, 1, 1, 5.0)])
    assert T.top_k(df.limit(0)).count() == 0 and T.top_k(df.where("vec_id = 7")).count() == 0
