import hashlib

import numpy as np
import pytest

from factweave.llm import bitplanes, catalogue


@pytest.mark.parametrize("low, high", [(0, 0), (-1, 0), (0, 1), (-64, 63), (-65, 64), (-(1 << 27), 1 << 27)])
def test_planes_give_exact_products(low, high):
    rng = np.random.default_rng(high + 7)
    bits = bitplanes.bits_for(low, high)
    x, c = rng.integers(low, high + 1, (50, 64)), rng.integers(low, high + 1, (7, 64))
    x[0], x[1] = low, high
    a, b = bitplanes.to_planes(x, bits), bitplanes.to_planes(c, bits)
    assert (bitplanes.from_planes(a) == x).all()
    want = x.astype(object) @ c.T.astype(object)
    assert (bitplanes.dots(a, b) == want).all()
    assert (bitplanes.norms(a) == (x.astype(object) ** 2).sum(1)).all()
    which, far = bitplanes.nearest(a, b)
    d = ((x.astype(object)[:, None] - c.astype(object)) ** 2).sum(2)
    assert far.tolist() == d.min(1).tolist() and which.tolist() == [int(r.tolist().index(min(r.tolist()))) for r in d]


def brute(rows, k, rounds, seed, scale):
    """The rule in plain Python: rows (vec_id, components)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), g in zip(kept, got) if g == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, j, d in out if j == c) for c in range(len(cents))]
    return sorted([(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in out], key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_query_equals_brute_force(spark, docs_folder):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{docs_folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = catalogue.QUERIES["op13_bit_plane_clusters"](spark, docs_folder).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 16, 3, 1, 64)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[0][1]), (50, None), (51, []), (52, rows[0][1][:63]), (53, [None, *rows[0][1][1:]]), (54, [float("nan")] * 64),
             (55, [float("inf"), *rows[0][1][1:]]), (56, [0.0] * 64), (57, [-1e6] + [1e6] * 63)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as cluster", "'x' as planes", "2 as distance", "3 as v", "4 as n")
    got, centroids = bitplanes.cluster(df, k=5, rounds=2, seed=9)
    assert centroids.shape == (5, 64)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == brute(rows, 5, 2, 9, 64)
    few, centroids = bitplanes.cluster(df.where("vec_id in (56, 51)"), k=5)
    assert len(centroids) == 1 and [tuple(r)[:5] for r in few.select(*COLUMNS).collect()] == [(56, 0, 0, 0, 0)]
    assert bitplanes.cluster(df.limit(0))[0].select(*COLUMNS).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [float(1 << 21)] * 64), (3, [2.0] * 64)], schema)
    assert {r["vec_id"] for r in bitplanes.cluster(huge)[0].collect()} == {3}  # beyond +-2^27 after scaling: no part


def test_sums_that_fit_no_long_are_null(spark):
    top, low = [float((1 << 21) - 1)] * 64, [-float((1 << 21) - 1)] * 64
    df = spark.createDataFrame([(i, v) for i, v in enumerate([top, low] * 3)], "vec_id long, embedding array<double>")
    got = bitplanes.cluster(df, k=1, rounds=0)[0].collect()
    assert len(got) == 6 and {r["inertia"] for r in got} == {None}
    assert all(r["distance"] >= 0 for r in got)
