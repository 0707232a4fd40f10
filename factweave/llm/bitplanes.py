"""Centroid clustering of 64-component integer vectors by bit planes and popcounts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .tables import query, table

COMPONENTS = 64  # one bit of each fills a 64-bit word
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
LIMIT = 1 << 27  # of a component's absolute value: any squared distance then fits 63 bits
BLOCK = 4096  # rows whose popcounts are in memory at once


# ------------------------------------------------------------------ planes in numpy
def weights(bits: int) -> list[int]:
    """What a bit of each plane counts, in two's complement: the last plane is negative."""
    return [1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))]


def bits_for(low: int, high: int) -> int:
    """Planes that hold every whole number from low to high, the sign's included."""
    return max(int(high).bit_length(), (-int(low) - 1).bit_length() if low < 0 else 0) + 1


def to_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits) words of x (rows, 64) whole numbers: bit i of word b is bit b of component i."""
    out = np.empty((len(x), bits), dtype="<u8")
    for b in range(bits):
        out[:, b] = np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers (rows, 64) that planes stand for."""
    out = np.zeros((len(planes), COMPONENTS), dtype=np.int64)
    for b, w in enumerate(weights(planes.shape[1])):
        column = np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(-1, 8)
        out += w * np.unpackbits(column, axis=1, bitorder="little").astype(np.int64)
    return out


def dots(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of a, rows of c): for each pair of planes the popcount of their AND, by both weights."""
    out = np.zeros((len(a), len(c)), dtype=np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(c.shape[1])):
            out += wi * wj * np.bitwise_count(a[:, i, None] & c[None, :, j]).astype(np.int64)
    return out


def norms(a: np.ndarray) -> np.ndarray:
    """Exact squared lengths of the rows of a."""
    out = np.zeros(len(a), dtype=np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(a.shape[1])):
            out += wi * wj * np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row: the nearest, of equally near ones the smaller number."""
    own = norms(centroids)
    which, far = np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
    for at in range(0, len(planes), BLOCK):
        part = planes[at: at + BLOCK]
        d = norms(part)[:, None] + own - 2 * dots(part, centroids)
        best = d.argmin(axis=1)
        which[at: at + BLOCK], far[at: at + BLOCK] = best, d[np.arange(len(part)), best]
    return which, far


# ------------------------------------------------------------------ on Spark
def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows of df(vec_id, embedding) whose vector has exactly 64 components, none null or
    non-finite, each x as floor(scale * x). A vector with a component beyond +-2^27 takes no part, as its squared
    distances might fit no long. Rows with a null id and repeated rows all count."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LIMIT))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == COMPONENTS) & fine)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v"))


def _numbers(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def packed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vectors(vec_id, v) as a written table (vec_id, planes array<long>), and its number of planes, which follows from the
    least and greatest component of the table (two numbers come to the driver)."""
    low, high = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    bits = bits_for(low or 0, high or 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = to_planes(_numbers(batch.column(1), COMPONENTS, "i8"), bits)
            words = pa.FixedSizeListArray.from_arrays(pa.array(planes.view("<i8").reshape(-1)), bits).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], ["vec_id", "planes"])

    return written(vectors.mapInArrow(pack, "vec_id long, planes array<long>"), "planes"), bits


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hex sha256 of "seed:vec_id" (nothing for a null id; of one id the smaller vector
    first), in that order; fewer if the table has fewer. k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(-1, COMPONENTS)


def moved(planes: DataFrame, bits: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each vector counts for its nearest centroid, and a centroid with vectors becomes the
    floor of their mean, component by component. A task sends one row of sums for each centroid, Spark adds them up."""
    words = to_planes(centroids, bits)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(words), np.int64), np.zeros((len(words), COMPONENTS), np.int64)
        for batch in batches:
            got = _numbers(batch.column(0), bits, "<u8")
            for at in range(0, len(got), BLOCK):
                part = got[at: at + BLOCK]
                which, x = nearest(part, words)[0], from_planes(part)
                for c in np.unique(which):
                    mine = which == c
                    count[c] += mine.sum()
                    total[c] += x[mine].sum(axis=0)
        some = np.flatnonzero(count)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(total[some].reshape(-1)), COMPONENTS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), lists], ["cluster", "n", "total"])

    parts = planes.select("planes").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(COMPONENTS)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        out[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(COMPONENTS)]
    return out


def assigned(planes: DataFrame, bits: int, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector of a packed table."""
    words = to_planes(centroids, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, far = nearest(_numbers(batch.column(1), bits, "<u8"), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return planes.select("vec_id", "planes").mapInArrow(assign, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of df(vec_id, embedding) that
    `whole_vectors` keeps, and the final centroids (k, 64).

    Vectors are packed once into words of one bit of each component; every round reads the packed table, and only k rows
    of sums come back. Nothing is shuffled but those sums, so no cluster can be too large. Equal vectors get equal rows;
    an inertia that fits no long is null; an empty table gives no rows. Columns beyond vec_id and embedding are not read.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema), centroids
    planes, bits = packed(vectors)
    for _ in range(rounds):
        centroids = moved(planes, bits, centroids)
    rows = written(assigned(planes, bits, centroids), "assigned")
    inertia = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, fits(n), fits(sum(inertia.values())), hashes[c]) for c, n in inertia.items()]
    # at most k rows
    of = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def _sql() -> str:
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
      WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CENTROIDS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT v.vec_id, v.c, k, list_sum(list_transform(range(1, {COMPONENTS + 1}), lambda i: (v.c[i] - m.c[i]) * (v.c[i] - m.c[i]))) AS d
      FROM v CROSS JOIN c{r} m),
    a{r} AS MATERIALIZED (SELECT vec_id, c, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, unnest(range(1, {COMPONENTS + 1})) AS i FROM a{r}) GROUP BY k, i),
    m{r} AS (SELECT k, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.c, ',')) AS centroid_sha256
    FROM a{ROUNDS} JOIN (SELECT k, c FROM c{ROUNDS}) f USING (k)"""


@query("op13_bit_plane_clusters", _sql())
def op13_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's cluster after three rounds, by popcounts of bit planes."""
    return cluster(table(spark, folder, "embeddings"))[0]
