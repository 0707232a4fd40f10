"""Approximate nearest neighbours by balanced posting lists (inner product)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import query, table
from .vectors import against, best, kept, matrix, sample, top_of, valid

SAMPLE = 8192  # vectors the centroids are fitted on
LISTS = 512  # posting lists at most; below that the square root of the number of vectors
COPIES = 4  # lists a boundary vector may stand in
NEAR = 0.08  # a vector also stands in lists whose centroid is at most this much farther than the nearest
REACH = 0.22  # a query reads the lists whose centroid is at most this much farther than the nearest
LEAST = 8  # and this many lists in any case
LINKS, SHORTCUTS = 16, 4
EPS = float(np.finfo(np.float64).eps)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component that brings all to the same length: the nearest by distance is then the one with the
    largest inner product."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a cluster that holds more than its share is pushed away by a price on its size."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    size = np.zeros(k)
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        price = d.min(axis=1).mean() * 0.1 * (size / max(len(x) / k, 1) - 1).clip(-1, 4)
        at = (d + price).argmin(axis=1)
        size = np.bincount(at, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), size=len(empty))]
    return c


class Navigator:
    """A graph over the centroids in memory: each has its nearest ones, those it is nearest to, and a few far ones."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        k = len(centroids)
        d = np.sqrt(np.maximum((centroids**2).sum(1)[:, None] - 2 * centroids @ centroids.T + (centroids**2).sum(1), 0))
        self.between = d
        links = np.argsort(d, axis=1, kind="stable")[:, : LINKS + 1]
        far = np.random.default_rng(5).integers(0, k, size=(k, SHORTCUTS))
        ring = (np.arange(k)[:, None] + 1) % k  # no centroid is out of reach
        self.links = np.hstack([links, far, ring])
        self.entry = int(d.sum(axis=1).argmin())

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk for all rows of x at once: the `width` nearest centroids found (nearest first), distances."""
        n, k = len(x), len(self.c)
        width = min(width, k)
        dist = np.full((n, k), np.inf)
        open_ = np.zeros((n, k), dtype=bool)
        rows = np.arange(n)
        dist[:, self.entry] = np.linalg.norm(x - self.c[self.entry], axis=1)
        open_[:, self.entry] = True
        active = rows
        while len(active):
            here = np.where(open_[active], dist[active], np.inf)
            at = here.argmin(axis=1)
            bound = np.partition(dist[active], width - 1, axis=1)[:, width - 1]
            go = (here[np.arange(len(active)), at] <= bound) & open_[active, at]
            active, at = active[go], at[go]
            if not len(active):
                break
            open_[active, at] = False
            near = self.links[at]
            new = np.isinf(np.take_along_axis(dist[active], near, axis=1))
            r, j = np.nonzero(new)
            a, b = active[r], near[r, j]
            dist[a, b] = np.sqrt(((x[a] - self.c[b]) ** 2).sum(axis=1))
            open_[a, b] = True
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return order, np.take_along_axis(dist, order, axis=1)

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list, and for a boundary vector others about as near, unless a list chosen before is
        nearer to that list than the vector is."""
        order, dist = self.search(x, 2 * COPIES)
        rows, lists = [np.arange(len(x))], [order[:, 0]]
        chosen = order[:, :1]
        count = np.ones(len(x), dtype=int)
        for j in range(1, order.shape[1]):
            ok = (dist[:, j] <= (1 + NEAR) * dist[:, 0]) & np.isfinite(dist[:, j]) & (count < COPIES)
            ok &= (self.between[order[:, j][:, None], chosen] >= dist[:, j][:, None]).all(axis=1)
            rows.append(np.flatnonzero(ok))
            lists.append(order[ok, j])
            count += ok
            chosen = np.hstack([chosen, np.where(ok, order[:, j], order[:, 0])[:, None]])
        return np.concatenate(rows), np.concatenate(lists)

    def probes(self, x: np.ndarray, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for queries: all lists within `reach` of the nearest, the LEAST nearest in any case."""
        order, dist = self.search(x, len(self.c))
        r, j = np.nonzero((dist <= (1 + reach) * dist[:, :1]) | (np.arange(order.shape[1]) < LEAST))
        return r, order[r, j]


def exact_scores(q: np.ndarray, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of chosen pairs, summed component by component: equal vectors get equal scores wherever they stand."""
    out = np.zeros(len(pairs[0]))
    for j in range(q.shape[1]):
        out += q[pairs[0], j] * x[pairs[1], j]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of vectors(vec_id, embedding) with the largest inner product that are
    found for each row of queries(vec_id, embedding), its own id excepted.

    Lists are fitted on at most SAMPLE vectors (by hash), every vector is put in one to COPIES lists, and a query reads
    the lists that the ratio of distances leaves. A query that finds fewer than k this way then reads all lists. Null, zero and non-finite vectors take no part on either side,
    nor do vectors of another length than most have; rows with equal vectors all count, ties go to the smaller id; of rows that share an id
    the best one counts; an empty table gives an empty result.
    """
    rows = kept(valid(vectors, nonzero=True))
    schema = "query_id long, vec_id long, score double"
    n, most = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return best(rows.sparkSession.createDataFrame([], schema), k)
    fitted = lifted(sample(rows, SAMPLE), most)
    lists = min(LISTS, max(1, int(np.sqrt(n))), len(fitted))
    nav = Navigator(balanced_centroids(fitted, lists))

    def placed(choose, name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    r, g = choose(matrix(part.column(1)).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r))], ["g", name, "v"])

        return run

    posted = kept(rows.mapInArrow(placed(lambda x: nav.homes(lifted(x, most)), "vec_id"), "g int, vec_id long, v array<double>"))
    asked = valid(queries, nonzero=True, length=fitted.shape[1] - 1)

    def probing(some: DataFrame, reach: float) -> DataFrame:
        return kept(some.mapInArrow(placed(lambda x: nav.probes(np.hstack([x, np.zeros((len(x), 1))]), reach), "query_id"), "g int, query_id long, v array<double>"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = matrix(left.column("v")).astype(np.float64), matrix(right.column("v")).astype(np.float64)
        ids, qids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        if not len(x) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rough = np.where(qids[:, None] == ids, -np.inf, q @ x.T)
        m = min(k, len(ids))
        kth = -np.partition(-rough, m - 1, axis=1)[:, m - 1: m]
        # what a sum of so many products of these lengths may be off by, on both sides of the comparison
        slack = 8 * (q.shape[1] + 2) * EPS * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1).max()
        near = np.nonzero((rough >= kth - slack) & (rough > -np.inf))
        s = np.full_like(rough, -np.inf)
        s[near] = exact_scores(q, x, near)
        r, c = top_of(s, ids, k)
        return pa.table({"query_id": qids[r], "vec_id": ids[c], "score": s[r, c]})

    found = kept(best(against(posted, probing(asked, REACH), lists, score, schema), k, COPIES))
    enough = found.where(F.col("rank") == k).select("query_id")
    short = kept(asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"))
    if short.isEmpty():
        return found
    more = best(against(posted, probing(short, float("inf")), lists, score, schema), k, COPIES)
    return found.join(enough, "query_id", "left_semi").unionByName(more)


@query("op3_posting_lists")
def op3_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)
