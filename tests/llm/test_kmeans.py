"""Exponion search against Lloyd's rounds over all centroids, with ties, repeated vectors and odd rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeloom.llm import kmeans

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def lloyd(rows, dims, k, rounds, scale, seed="3"):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, w) in zip(kept, to) if w == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i, w, d) for (i, _), (d, w) in zip(kept, assign())), key=str), c


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(2, 6), st.sampled_from([2, 5, 1000]))
def test_search_finds_the_nearest(seed, k, rounds, span):
    r = np.random.default_rng(seed)
    v = r.integers(-span, span, (80, 3)).astype(np.int64)
    own, upper, lower = np.full(80, -1), np.full(80, np.inf), np.zeros(80)
    before = None
    at = r.integers(-span, span, (k, 3)).astype(np.int64)
    for _ in range(rounds):
        kmeans.nearest(v, own, upper, lower, kmeans.Centroids(at, before))
        d = ((v[:, None, :] - at[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()  # the first of equal ones
        assert (upper >= np.sqrt(d.min(1))).all()
        if k > 1:
            others = np.where(np.arange(k) == own[:, None], 1 << 60, d)
            assert (lower <= np.sqrt(others.min(1))).all()
        before, at = at, at + r.integers(-span // 2, span // 2 + 1, (k, 3))


def test_bounds_spare_distances():
    r = np.random.default_rng(1)
    middles = r.integers(-30_000, 30_000, (60, 8))
    v = (middles[r.integers(0, 60, 5_000)] + r.integers(-300, 300, (5_000, 8))).astype(np.int64)
    own, upper, lower = np.full(5_000, -1), np.full(5_000, np.inf), np.zeros(5_000)
    at, before, seen = v[:60].copy(), None, []
    for _ in range(6):
        c = kmeans.Centroids(at, before)
        seen.append(kmeans.nearest(v, own, upper, lower, c))
        before, at = at, np.array([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else at[j] for j in range(60)])
    assert seen[0] == 5_000 * 60 and sum(seen[1:]) < 5 * 5_000 * 60 / 5


def test_rounds_match_lloyd(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 1, 4).round(1).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(400, 520)] + rows[:5] + [(None, [0.1, 0.2, 0.3, 0.4])]  # a vector of many ids, repeated rows
    odd = [(600, None), (601, [1.0, 2.0, None, 3.0]), (602, [1.0, float("nan"), 0.0, 0.0]), (603, [float("inf"), 0.0, 0.0, 0.0]), (604, [1.0]), (605, []), (606, [1.0] * 5)]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], SCHEMA).repartition(5)
    got, at = kmeans.cluster(docs, dims=4, k=6, rounds=10, scale=10)
    want, centroids = lloyd(rows + odd, 4, 6, 10, 10)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want and at == centroids
    out = kmeans.clusters(docs, dims=4, k=6, rounds=10, scale=10).collect()
    assert len(out) == len(want)
    for x in out:
        assert x["inertia"] == sum(d for *_, d in want) and x["cluster_inertia"] == sum(d for _, w, d in want if w == x["cluster"])
        assert x["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[x["cluster"]])).encode()).hexdigest()


def test_few_equal_or_no_vectors(spark):
    few = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-5.0, 2.5])]
    got, at = kmeans.cluster(spark.createDataFrame(few, "vec_id long, embedding array<float>"), dims=2)
    assert (sorted((tuple(x) for x in got.collect()), key=str), at) == lloyd(few, 2, 8, 10, 1024)
    assert kmeans.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    big = [(i, [float(i * 1_000), -30_000.0]) for i in range(30)]
    got, at = kmeans.cluster(spark.createDataFrame(big, "vec_id long, embedding array<double>"), dims=2, k=3)
    assert (sorted((tuple(x) for x in got.collect()), key=str), at) == lloyd(big, 2, 3, 10, 1024)
    with pytest.raises(Exception, match="no exact squared distance"):
        kmeans.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2)
