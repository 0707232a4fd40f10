"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import dense_number
from .common import WORD, running_total, written
from .tables import query, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3


def _targets(rows: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """(skey, sid, source_size, target): the whole size shared out by weight, no source above `epochs` times its own.

    A source that reaches its limit keeps it and the rest is shared again by weight, until none is above; each step is
    one small aggregate over the sources, and only its two sums come to the driver.
    """
    sizes = rows.groupBy("skey", "no_source").agg(F.sum("size").alias("source_size"))
    numbered = dense_number(sizes, ["no_source", "skey"], "sid", start=0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = written(numbered.select("skey", F.col("sid").cast("long").alias("sid"), "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("most")), "sources")
    level = float("-inf")
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        total, held, open_weight = (x or 0 for x in got)
        if not open_weight:
            break
        new = (total - held) / open_weight
        if new <= level:
            break
        level = new
    share = F.col("weight") * F.lit(max(level, 0.0))
    return sources.select("skey", "sid", "source_size", F.least(F.col("most").cast("double"), share.cast("double")).alias("target"))


def mix(docs: DataFrame, size_col: str, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """What a mix to target weights takes of each row of docs(doc_id, source, <size_col>, ...): doc_id, source, fp, size,
    source_size, target, taken. fp tells rows apart that differ in any column given.

    Sources in code point order, null last, weigh `weights` over and over and share the whole size; see `_targets`.
    Each source's rows queue up in the order of a hash of their id, up to `epochs` times over. A row's virtual finish
    time is the source's size up to and with it, divided by the source's target; all rows of all queues are
    range-sorted by it, and the mix ends where the next row would go above the total. taken counts repeats.

    Two levels (a source, a slice of the hash) keep a source that holds most rows from being one task. Rows of size
    zero take nothing; a null source is a source of its own; equal rows share what they take between them; an empty
    table gives an empty result. Columns of docs with clashing names do no harm: only the named ones are used.
    """
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.col("source"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("fp"),
        F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.col("source"), F.lit("")).alias("skey"), F.col("source").isNull().alias("no_source"), F.md5(text_id).alias("at"))
    rows = written(rows.withColumn("skey", F.concat(F.when(F.col("no_source"), "-").otherwise("+"), "skey")).withColumn("slice", F.substring("at", 1, 3)), "sizes")
    targets = _targets(rows, weights, epochs)

    slices = rows.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0))).join(targets, "skey").drop("slice_size")
    inside = Window.partitionBy("skey", "slice").orderBy("at", "doc_id", "size", "fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = rows.join(slices, ["skey", "slice"]).withColumn("upto", F.col("base") + F.sum("size").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside))
    queued = written(queued.select("doc_id", "source", "fp", "size", "sid", "slice", "nth", "source_size", "target", "upto"), "queues")

    copies = queued.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    copies = copies.withColumn("upto", F.col("upto") + F.col("epoch") * F.col("source_size"))
    copies = copies.select("sid", "slice", "nth", "size", "upto", (F.col("upto") / F.col("target")).alias("finish"))
    ordered = running_total(copies, ["finish", "sid", "upto"], "size", "total")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    taken = ordered.where(F.col("total") <= F.lit(budget)).groupBy("sid", "slice", "nth").agg(F.sum("size").alias("taken"))
    out = queued.join(taken, ["sid", "slice", "nth"], "left")
    return out.select("doc_id", "source", "fp", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, size_col: str, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs that the mix takes, a row as often as it is taken, with the columns of docs but for size_col."""
    counts = mix(docs, size_col, weights, epochs).where("taken > 0")
    # rows that are equal in every column are one row here, taken as often as all of them
    counts = counts.groupBy(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).agg(F.sum(F.expr("taken div size")).alias("__n"))
    rows = docs.withColumn("__fp", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    first = Window.partitionBy("doc_id", "__fp").orderBy(F.lit(0))
    rows = rows.withColumn("__one", F.row_number().over(first)).where("__one = 1")
    joined = rows.join(counts, F.col("doc_id").eqNullSafe(F.col("__id")) & (rows["__fp"] == counts["__fp"]))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns if c != size_col])


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hs FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
s1 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most FROM s0),
s2 AS (SELECT *, (sum(most) OVER o - most)::DOUBLE AS held, (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS open_w,
              (SELECT sum(source_size) FROM s0)::DOUBLE AS total
       FROM s1 WINDOW o AS (ORDER BY most::DOUBLE / w, sid ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT coalesce(max((total - held) / open_w) FILTER (WHERE most::DOUBLE / w > (total - held) / open_w), 0) AS level FROM s2),
t AS (SELECT source, sid, source_size, least(most::DOUBLE, w * level) AS target FROM s1, lv),
q AS (SELECT d.*, t.sid, t.source_size, t.target,
             sum(size) OVER (PARTITION BY t.sid ORDER BY hs, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, sid, (upto + e * source_size)::DOUBLE / target AS finish, upto + e * source_size AS pos
      FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, sid, pos ROWS UNBOUNDED PRECEDING) AS total FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM r WHERE total <= (SELECT sum(source_size) FROM s0) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""


@query("op1_mix_sources", SQL)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a mix of all sources to the weights 5, 2, 1 takes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken")
