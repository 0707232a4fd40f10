import duckdb
import numpy as np
import pytest

from factweave.llm import catalogue, pivots, postings


def load(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)


def test_posting_lists_find_nine_in_ten(spark, docs_folder):
    ids, x = load(spark, docs_folder)
    got = {}
    for r in catalogue.QUERIES["op3_posting_lists"](spark, docs_folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    q = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[q].tolist())
    hits = 0
    for i in q:
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s, kind="stable")[:20]].tolist())
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - s[np.searchsorted(ids, m[1])]) < 1e-12 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len(best & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * len(q)


def test_pivot_search_equals_sql(spark, docs_folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{docs_folder}/embeddings.parquet'")
    cols = "query_id, rank, vec_id, score"
    want = con.execute(f"SELECT {cols} FROM ({catalogue.SQL['op5_pivot_search']}) ORDER BY 1, 2").fetchall()
    got = catalogue.QUERIES["op5_pivot_search"](spark, docs_folder).select(*cols.split(", ")).orderBy("query_id", "rank").collect()
    assert list(map(tuple, got)) == want


ODD = [
    (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
    (8, [None, 1.0]), (9, [-3.0, 0.25]), (None, [1.0, 1.0]), (10, [1e30, -1e30]), (11, [1.0, 2.0, 3.0]), (12, []), (20, [2.0, 1.0]),
]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "1 as rank", "1 as g", "1 as query_id")
    got = postings.search(df, df.where("vec_id in (0, 5, 4, 11)"), 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 10), (0, 20), (0, 1)]
    got = pivots.search(df, df.where("vec_id in (0, 5)"), 4).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [10, 20, 1, 2]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 5] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    for search in (postings.search, pivots.search):
        assert search(df.limit(0), df.limit(0), 5).count() == 0
        assert search(df.where("vec_id < 2"), df.where("vec_id = 0"), 5).count() == 1


def test_elimination_is_exact_and_spares_work():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8)) * 4
    x = pivots.whole(centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 0.2)
    most = float((x * x).sum(1).max())
    table = pivots.PivotTable(x[:500], most)
    q = x[:20]
    upper = table.upper(q, table.of_queries(q), table.of_rows(x))
    exact = (q @ x.T).astype(np.int64)
    assert (upper >= exact).all()
    ids = np.arange(len(x))
    r, c, s, seen = pivots.eliminate(q, x, upper, np.full(20, -np.inf), ids, 5)
    for i in range(20):
        want = np.lexsort((ids, -exact[i]))[:5]
        assert c[r == i].tolist() == want.tolist() and s[r == i].tolist() == exact[i, want].tolist()
    assert seen < exact.size


def test_pivot_search_over_many_blocks_equals_brute_force(spark, monkeypatch):
    """Clusters of all sizes, one with a third of the rows, in blocks of 64: most are never moved to a query."""
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(9)
    at = np.concatenate([np.zeros(1000, int), rng.integers(1, 30, 2000)])
    x = rng.normal(size=(30, 6))[at] * 3 + rng.normal(size=(3000, 6)) * 0.1
    ids = np.arange(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in pivots.search(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    w = pivots.whole(x).astype(np.int64)
    for i in ids[::50]:
        s = w @ w[i]
        other = ids[ids != i]
        want = other[np.lexsort((other, -s[other]))][:5]
        assert got[i] == [(j, s[j]) for j in want]


def test_repeated_ids(spark):
    """Rows that share an id all count in the exact search; of queries that share one the smallest vector asks."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = pivots.search(df, df.where("vec_id = 1"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 3 * 256 * 256), (2, 0), (2, 0)]


def test_long_vectors_with_small_products(spark):
    """Components near 1e6 and products near 0: the rounding of a matrix product is larger than the scores' differences."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64)) * 1e6
    x[1:] -= np.outer(x[1:] @ x[0] / (x[0] @ x[0]), x[0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in postings.search(df, df.where("vec_id = 0"), 20).orderBy("rank").collect()]
    s = np.zeros(400)
    for j in range(64):
        s += x[0, j] * x[:, j]
    s[0] = -np.inf
    want = np.lexsort((np.arange(400), -s))[:20]
    assert got == [(int(i), float(s[i])) for i in want]


def test_rows_that_share_an_id_give_their_best(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = postings.search(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3.0), (2, 2.0)]


@pytest.mark.parametrize("k", [1, 7])
def test_graph_search_finds_centroids(k):
    rng = np.random.default_rng(k)
    nav = postings.Navigator(rng.normal(size=(200, 16)))
    x = rng.normal(size=(50, 16))
    order, dist = nav.search(x, 200)
    d = np.linalg.norm(x[:, None] - nav.c, axis=2)
    assert (np.sort(d, axis=1) == pytest.approx(dist))
