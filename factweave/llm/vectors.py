"""What the two searches over vectors share: valid rows, bounded samples, and blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024


def valid(df: DataFrame, nonzero: bool, length: int | None = None) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector has no null or non-finite component (and, if asked, one that is not
    zero) and the given length, or else the most frequent one (the greater, if two are). Rows without an id take no part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    if length is not None:
        return rows.where(F.size("v") == length)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (top[0] if top else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most `size` vectors, the first by a hash of their id: a fixed bound, whatever the table's size."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("v").toArrow()
    return matrix(got.column(0)).astype(np.float64)


def _by_group(values: dict[int, int], groups: int) -> Column:
    return F.element_at(F.array(*[F.lit(max(1, values.get(g, 0))) for g in range(groups)]), F.col("g") + 1)


def against(rows: DataFrame, queries: DataFrame, groups: int, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """score(rows, queries) over blocks: rows(g, vec_id, ...) meet queries(g, query_id, ...) of their group g (0 to
    groups - 1).

    A group's rows are cut by a hash of the id into blocks of about BLOCK_ROWS, its queries into blocks of about
    BLOCK_QUERIES, and each pair of blocks is one group of a cogroup: no task holds more, however large a group is.
    Only the counts by group (groups numbers) come to the driver.
    """
    n_rows = {r[0]: -(-r[1] // BLOCK_ROWS) for r in rows.groupBy("g").count().collect()}
    n_queries = {r[0]: -(-r[1] // BLOCK_QUERIES) for r in queries.groupBy("g").count().collect()}
    of_rows, of_queries = _by_group(n_rows, groups), _by_group(n_queries, groups)
    left = rows.withColumn("vp", F.pmod(F.xxhash64("vec_id"), of_rows).cast("int")).withColumn("qp", F.explode(F.sequence(F.lit(0), of_queries - 1)))
    right = queries.withColumn("qp", F.pmod(F.xxhash64("query_id"), of_queries).cast("int")).withColumn("vp", F.explode(F.sequence(F.lit(0), of_rows - 1)))
    key = ["g", "vp", "qp"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, schema)


def best(hits: DataFrame, k: int, copies: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores, ties to the smaller id. A pair may come up to
    `copies` times, so the first k * copies are enough; they are cut below the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    few = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k * copies)
    if copies > 1:
        few = few.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return few.select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores, ties to the smaller id; -inf is never taken."""
    k = min(k, scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1: k]
    r, c = np.nonzero((scores >= kth) & (scores > -np.inf))
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def kept(rows: DataFrame) -> DataFrame:
    return written(rows, "vectors")
