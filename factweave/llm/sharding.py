"""Resharding by a minimum-cost flow of bytes from old shards to new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path
from .tables import query, table

SLICES = 4096  # blocks of an old shard
OLD, NEW = 16, 24


def cheapest_transfers(supply: Sequence[int], capacity: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) arcs that bring all of `supply` into `capacity` (equal sums) and move the fewest bytes.

    A byte that stays in the shard of the same number costs 0, any other 1. Successive shortest paths over the two rows
    of shards: each round finds the cheapest way with room from a shard with bytes left to one with room left, which
    may take back bytes placed before, and fills it.
    """
    m, n = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow = [[0] * n for _ in range(m)]
    cost = [[0 if i == j else 1 for j in range(n)] for i in range(m)]
    far = float("inf")
    while any(left):
        at = [0 if left[i] else far for i in range(m)] + [far] * n
        came: list[int | None] = [None] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    if at[i] + cost[i][j] < at[m + j]:
                        at[m + j], came[m + j], changed = at[i] + cost[i][j], i, True
                    if flow[i][j] and at[m + j] - cost[i][j] < at[i]:
                        at[i], came[i], changed = at[m + j] - cost[i][j], m + j, True
        end = min((j for j in range(n) if room[j]), key=lambda j: (at[m + j], j))
        path, v = [], m + end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end], *(flow[b][a - m] for a, b in path if a >= m)])
        for a, b in path:
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        left[v] -= amount
        room[end] -= amount
    return [(i, j, flow[i][j]) for i in range(m) for j in range(n) if flow[i][j]]


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_shard: str, old_shards: int, new_shards: int, path: str | None = None) -> DataFrame:
    """The rows of docs(doc_id, text, <old_shard> from 0 to old_shards - 1, ...) in new_shards shards of near equal bytes,
    with size, text_crc32, shard, slot (gapless from 0 in each shard) and moved.

    A row's size is the text's UTF-8 bytes (none for null) plus 8. Old shards are cut into blocks by a hash of the id;
    blocks have sizes, shards are sums of blocks, and `cheapest_transfers` says how many bytes go from which old shard
    to which new one. The old shard's line of blocks is cut at these amounts (a row goes where its middle lies), so
    whole blocks move and only those at a cut are split. The rows of affected shards are written as files below
    `path` (a fresh folder of the shared one if not given), one folder a shard, and read back; a shard that neither
    gives nor gets anything is not rewritten.

    Ids may be null or repeat; equal rows get neighbouring slots. An empty table gives an empty result. Columns of docs named
    like the new ones (size, text_crc32, shard, slot, moved) are replaced.
    """
    spark = docs.sparkSession
    new = ["size", "text_crc32", "shard", "slot", "moved"]
    keep = [c for c in docs.columns if c not in new and c != old_shard]
    at = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(old_shard).cast("int").alias("__old"), at.alias("__at"),
        F.conv(F.substring(at, 1, 3), 16, 10).cast("int").alias("__slice"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    blocks = rows.groupBy("__old", "__slice").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("__old").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).persist()
    supply = [0] * old_shards
    for r in blocks.groupBy("__old").agg(F.sum("bytes").alias("b")).collect():  # old_shards rows
        supply[r[0]] = r[1]
    arcs = cheapest_transfers(supply, even(sum(supply), new_shards))
    same = {i for i, j, b in arcs if i == j and b == supply[i] and sum(1 for x in arcs if x[1] == j) == 1}
    # (new shard, first byte) of each cut of each old shard's line; a constant in the plan, of old + new entries at most
    cuts: dict[int, list[tuple[int, int]]] = {}
    upto = [0] * old_shards
    for i, j, b in arcs:
        cuts.setdefault(i, []).append((j, upto[i]))
        upto[i] += b

    inside = Window.partitionBy("__old", "__slice").orderBy("__at", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most old_shards * SLICES rows, whatever the table's size
    placed = rows.repartitionByRange("__old", "__slice").join(F.broadcast(blocks.select("__old", "__slice", "__base")), ["__old", "__slice"])
    placed = placed.withColumn("__middle", 2 * (F.col("__base") + F.sum("size").over(inside)) - F.col("size"))
    shard = F.lit(None).cast("int")
    for i, line in cuts.items():
        to = F.lit(line[0][0])
        for j, first in line[1:]:
            to = F.when(F.col("__middle") >= 2 * first, j).otherwise(to)
        shard = F.when(F.col("__old") == i, to).otherwise(shard)
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("__nth", F.row_number().over(Window.partitionBy("__old", "__slice", "shard").orderBy("__at", "doc_id", "size", "text_crc32")))
    placed = placed.drop("__base", "__middle", "__at")

    path = path or fresh_path(spark, "shards")
    affected = placed.where(~F.col("__old").isin(*same)) if same else placed
    affected.write.mode("append").partitionBy("shard").parquet(path)
    files = spark.read.schema(placed.schema).parquet(path)
    stay = placed.where(F.col("__old").isin(*same)) if same else None
    out = files.unionByName(stay) if stay is not None else files

    counts = out.groupBy("shard", "__old", "__slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("__old", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__old", "__slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__first"))
    out = out.join(F.broadcast(first), ["shard", "__old", "__slice"])  # at most a row for each block and cut
    slot = (F.col("__first") + F.col("__nth") - 1).cast("long").alias("slot")
    return out.select(*[F.col(f"`{c}`") for c in keep], "size", "text_crc32", "shard", slot, (F.col("shard") != F.col("__old")).alias("moved"))


@query("op2_reshard")
def op2_reshard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, kept until now in 16 shards by source, in 24 shards of near equal bytes."""
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD)).cast("int")
    got = reshard(docs.select("doc_id", "text", old.alias("old")), "old", OLD, NEW)
    # size and checksum are taken from the text as read back from the files
    text = F.coalesce(F.col("text"), F.lit(""))
    return got.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")
