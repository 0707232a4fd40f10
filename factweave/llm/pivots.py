"""Exact top-k search by elimination with a pivot table (integer inner product)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import query, table
from .vectors import BLOCK_QUERIES, BLOCK_ROWS, against, best, kept, matrix, sample, valid

SAMPLE = 4096  # vectors the pivots are chosen from
PIVOTS = 64
NEAREST = 4  # rows are sorted by their nearest pivots, so many of them, before they are cut into blocks
FIRST = 2  # blocks with the best bounds that a query meets before all others
STEP = 64  # candidates of a query in the first stratum of bounds; each later one is 8 times larger
DENSE = 16  # a query with more than 1 / DENSE of a block still open takes the rest of it in one matrix product
TILE = 128  # queries whose bounds are held at once
EXACT = float(1 << 53)
LOWEST = np.iinfo(np.int64).min


def whole(x: np.ndarray) -> np.ndarray:
    """Components as integers, floor(256 x), held as doubles (which have every integer up to 2^53)."""
    return np.floor(256.0 * x.astype(np.float64))


def in_doubles(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether no partial sum of an inner product can leave the integers that doubles hold, in whatever order it is added."""
    return bool((np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1]) < EXACT)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of q (n, d) and x (n, d) as 64-bit integers. Where doubles might round, Python's integers
    are used; a product beyond 64 bits counts as the largest (smallest) 64-bit integer."""
    if in_doubles(q, x):
        return np.einsum("nd,nd->n", q, x).astype(np.int64)
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([min(hi, max(lo, sum(int(u) * int(v) for u, v in zip(a, b)))) for a, b in zip(q, x)], dtype=np.int64)


class PivotTable:
    """Distances to pivots after lifting all rows to one length, where the largest inner product is the least distance. They
    are held as 32-bit floats in units of that length; what this rounds off is added to the bounds."""

    def __init__(self, chosen: np.ndarray, most: float):
        self.most = most
        self.unit = np.sqrt(most) if most > 0 else 1.0
        lifted = self._lift(chosen)
        at = [0]
        gap = ((lifted - lifted[0]) ** 2).sum(1)
        while len(at) < min(PIVOTS, len(lifted)) and gap.max() > 0:
            at.append(int(gap.argmax()))  # the row farthest from all pivots so far
            gap = np.minimum(gap, ((lifted - lifted[at[-1]]) ** 2).sum(1))
        self.pivots = lifted[at]

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    def _to(self, x: np.ndarray) -> np.ndarray:
        far = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.pivots], axis=1) / self.unit
        return np.minimum(far, 1e30).astype(np.float32)  # a query may be longer than all rows: a shorter distance only weakens its bounds

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._to(self._lift(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._to(np.hstack([q, np.zeros((len(q), 1))]))

    def _above(self, squares: np.ndarray, low: np.ndarray) -> np.ndarray:
        far = squares[:, None] + self.most
        with np.errstate(invalid="ignore", over="ignore"):
            out = (far - (low.astype(np.float64) * self.unit) ** 2) / 2 + 4e-6 * far + 0.5
        return np.where(np.isnan(out), np.inf, out)

    def upper(self, q: np.ndarray, dq: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """No inner product of a query with a row is above this: the largest difference of their distances to one pivot is a
        lower bound of their own distance."""
        low, gap = np.zeros((len(dq), len(dx)), np.float32), np.empty((len(dq), len(dx)), np.float32)
        for a, b in zip(dq.T, np.ascontiguousarray(dx.T)):
            np.subtract(a[:, None], b, out=gap)
            np.maximum(low, np.abs(gap, out=gap), out=low)
        return self._above((q * q).sum(1), low)

    def upper_of_blocks(self, squares: np.ndarray, dq: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The same for a query (its squared length) and any row of a block, from the block's least and largest distances."""
        low = np.zeros((len(dq), len(lo)), np.float32)
        for a, b, c in zip(dq.T, lo.T, hi.T):
            np.maximum(low, np.maximum(b - a[:, None], a[:, None] - c), out=low)
        return self._above(squares, low)


def eliminate(q: np.ndarray, x: np.ndarray, upper: np.ndarray, least: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, row of x, score) of each query's k highest scores that reach `least`, and how many were evaluated.

    Candidates are taken in strata of falling bounds, the first of STEP; a query ends when no open bound reaches both its
    k-th best score so far and `least`. upper is -inf for a pair that doesn't count. A query with much of the block
    still open after a stratum takes all that is open at once.
    """
    n, m = upper.shape
    scores, floor = np.full((n, m), LOWEST, dtype=np.int64), least.astype(np.float64).copy()
    open_, seen = (upper > -np.inf) & (upper >= floor[:, None]), np.zeros((n, m), dtype=bool)
    safe, evaluated, take = in_doubles(q, x), 0, min(STEP, m)
    while open_.any():
        count = open_.sum(axis=1)
        rest = np.flatnonzero((count > 0) & ((count <= take) | (safe & (take > STEP) & (count * DENSE > m))))
        some = np.setdiff1d(np.flatnonzero(count), rest)
        now = np.zeros((n, m), dtype=bool)
        now[rest] = open_[rest]
        if len(some):
            bounds = np.where(open_[some], upper[some], -np.inf)
            now[some] = open_[some] & (bounds >= np.partition(bounds, m - take, axis=1)[:, m - take, None])
        many = now.sum(axis=1) * DENSE > m if safe else np.zeros(n, dtype=bool)
        if many.any():
            scores[many] = np.where(now[many], (q[many] @ x.T).astype(np.int64), scores[many])
        r, c = np.nonzero(now & ~many[:, None])
        for at in range(0, len(r), 1 << 16):
            i, j = r[at: at + (1 << 16)], c[at: at + (1 << 16)]
            scores[i, j] = products(q[i], x[j])
        evaluated += int(many.sum()) * m + len(r)
        seen |= now
        active = np.flatnonzero(now.any(axis=1))
        if m >= k:
            done = np.where(seen[active], scores[active].astype(np.float64), -np.inf)
            kth = np.partition(done, m - k, axis=1)[:, m - k]
            # a double may round a large score up: step back so that no candidate is lost
            floor[active] = np.fmax(floor[active], kth - np.abs(kth) * 1e-15)
        open_ &= ~now & (upper >= floor[:, None])
        take = min(8 * take, m)
    with np.errstate(invalid="ignore"):
        r, c = np.nonzero(seen & (scores.astype(np.float64) >= (floor - np.where(np.isfinite(floor), np.abs(floor), 0) * 1e-15)[:, None]))
    order = np.lexsort((ids[c], ~scores[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[nth < k], c[nth < k]
    return r, c, scores[r, c], evaluated


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(flat.type))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS neighbours in the order the rows come in; a block's last row carries its least and
    largest distance to each pivot."""
    number = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        d = matrix(batch.column("d"))
        cuts = np.linspace(0, n, -(-n // BLOCK_ROWS) + 1).astype(int)
        spans = list(zip(cuts[:-1], cuts[1:]))
        place = np.full(n, -1)
        place[cuts[1:] - 1] = np.arange(len(spans))
        taken = pa.array(place, mask=place < 0)
        block = batch.column("part").to_numpy().astype(np.int64) * (1 << 32) + number + np.repeat(np.arange(len(spans)), np.diff(cuts))
        number += len(spans)
        lo, hi = _lists(np.stack([d[a:b].min(axis=0) for a, b in spans])), _lists(np.stack([d[a:b].max(axis=0) for a, b in spans]))
        yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("vec_id"), batch.column("v"), batch.column("d"), lo.take(taken), hi.take(taken)], ["block", "vec_id", "v", "d", "lo", "hi"])


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of vectors(vec_id, embedding) with the highest integer inner product
    for each row of queries(vec_id, embedding), its own id excepted; components count as floor(256 x).

    Pivots come from at most SAMPLE vectors (by hash). Rows are sorted by their nearest pivots and cut into blocks, each
    with its least and largest distance to every pivot, and written once. A query first meets the FIRST blocks with the
    best bounds, which gives a score to beat; of the other blocks only those whose bound reaches that score are
    moved to it, and in a block the candidates' own bounds rule out again. The result is exact, whatever the pivots are.
    Vectors that are null or hold null or non-finite components or have another length than most take no part; equal
    vectors all count, rows that share an id too, ties go to the smaller id; of queries that share an id the smallest
    vector asks; an empty table gives an empty result.
    """
    rows = valid(vectors, nonzero=False)
    schema = "query_id long, vec_id long, score long"
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * 256 + 1, F.lit(2.0))))).first()[0]
    if longest is None:
        return best(rows.sparkSession.createDataFrame([], schema), k)
    chosen = whole(sample(rows, SAMPLE))
    pivots, dims = PivotTable(chosen, longest), chosen.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column(1)))
            d = pivots.of_rows(x)
            near = np.argsort(d, axis=1, kind="stable")[:, :NEAREST]
            cell = (near * PIVOTS ** np.arange(near.shape[1])[::-1]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), _lists(x), _lists(d)], ["cell", "vec_id", "v", "d"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = whole(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(q), _lists(pivots.of_queries(q)), pa.array((q * q).sum(axis=1))], ["query_id", "v", "d", "squares"])

    order = ["cell", F.xxhash64("vec_id"), "vec_id"]  # the hash lets a cell of any size fall into several ranges
    ranged = rows.mapInArrow(placed, "cell long, vec_id long, v array<double>, d array<float>").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id()).drop("cell")
    table_ = kept(ranged.mapInArrow(_cut, "block long, vec_id long, v array<double>, d array<float>, lo array<float>, hi array<float>"))
    blocks = table_.where(F.col("lo").isNotNull()).select(F.lit(0).alias("g"), F.col("block").alias("vec_id"), "lo", "hi")
    asking = valid(queries, nonzero=False, length=dims).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = kept(asking.mapInArrow(measured, "query_id long, v array<double>, d array<float>, squares double"))

    def bounded(choose):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            names, qids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            if len(names):
                lo, hi = matrix(left.column("lo")), matrix(left.column("hi"))
                for at in range(0, len(qids), TILE):
                    part = right.slice(at, TILE)
                    upper = pivots.upper_of_blocks(part.column("squares").to_numpy(), matrix(part.column("d")), lo, hi)
                    r, c = np.nonzero(choose(upper, names, part))
                    found.append((qids[at + r], names[c], upper[r, c]))
            return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "block", "upper"), zip(*found))})

        return run

    def leading(upper: np.ndarray, names: np.ndarray, part: pa.Table) -> np.ndarray:
        place = np.argsort(np.lexsort((np.broadcast_to(names, upper.shape), -upper), axis=1), axis=1)
        return place < FIRST

    def reaching(upper: np.ndarray, names: np.ndarray, part: pa.Table) -> np.ndarray:
        seen = np.zeros(upper.shape, dtype=bool)
        met = part.column("met").combine_chunks()
        r = np.repeat(np.arange(len(met)), np.diff(met.offsets.to_numpy()))
        for i, block in zip(r, met.flatten().to_numpy(zero_copy_only=False)):
            seen[i] |= names == block
        return ~seen & (upper >= part.column("least").to_numpy()[:, None])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        if len(ids):
            x, dx, least = matrix(left.column("v")), matrix(left.column("d")), right.column("least").to_numpy()
            for at in range(0, len(qids), TILE):
                part, own = right.slice(at, TILE), qids[at: at + TILE]
                q = matrix(part.column("v"))
                upper = pivots.upper(q, matrix(part.column("d")), dx)
                upper[own[:, None] == ids] = -np.inf
                r, c, s, _ = eliminate(q, x, upper, least[at: at + TILE], ids, k)
                found.append((own[r], ids[c], s))
        return pa.table({n: np.concatenate(v) for n, v in zip(("query_id", "vec_id", "score"), zip(*found))})

    def met(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """Scores of the chosen blocks; a block that many queries chose meets them in parts of about BLOCK_QUERIES."""
        parts = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
        left = table_.select("block", "vec_id", "v", "d").join(parts, "block").withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = pairs.join(parts, "block").withColumn("qp", F.pmod(F.xxhash64("query_id"), "parts").cast("int")).drop("parts").join(of, "query_id")
        return left.groupBy("block", "qp").cogroup(right.groupBy("block", "qp")).applyInArrow(score, schema)

    bounds = "query_id long, block long, upper double"
    light = asked.select(F.lit(0).alias("g"), "query_id", "d", "squares")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "block"))
    ahead = kept(against(blocks, light, 1, bounded(leading), bounds).withColumn("nth", nth).where(F.col("nth") <= FIRST).select("query_id", "block"))
    first = kept(best(met(ahead, asked.withColumn("least", F.lit(float("-inf")))), k))
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    least = F.coalesce("least", F.lit(float("-inf")))
    least = (least - F.when(least > float("-inf"), F.abs(least) * 1e-15).otherwise(0.0)).alias("least")  # a double may round a large score up
    floors = kept(ahead.groupBy("query_id").agg(F.collect_list("block").alias("met")).join(reached, "query_id", "left").select("query_id", "met", least))
    others = kept(against(blocks, light.join(floors, "query_id"), 1, bounded(reaching), bounds).select("query_id", "block"))
    more = met(others, asked.join(floors.select("query_id", "least"), "query_id"))
    return best(first.select("query_id", "vec_id", "score").unionByName(more), k)


SQL = """
WITH e AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_pivot_search", SQL)
def op5_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
