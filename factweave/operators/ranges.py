"""Position and interval lookups inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 4096


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """Adds char_offset and char_end of each page in the text joined with single newlines."""
    from .ranking import prefix_sum

    out = prefix_sum(pages, [doc], page, F.length(text) + 1, "char_offset")
    return out.withColumn("char_end", F.col("char_offset") + F.length(text))


def _spread(df: DataFrame, start, end, name: str = "bucket") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET))))


def page_at_char(points: DataFrame, pages: DataFrame, doc: str = "doc_id", at: str = "char_pos") -> DataFrame:
    """Page holding a character: offset <= at < end; past the last page the last page; else null.

    Both sides meet on (doc, character bucket), so a point only sees the few pages that touch its
    bucket even in a document with very many pages.
    """
    spans = _spread(
        pages.where(F.col("char_end") > F.col("char_offset")),
        F.col("char_offset"), F.col("char_end") - 1,
    ).select(doc, "bucket", "page_number", "char_offset", "char_end")
    probes = points.withColumn("bucket", F.floor(F.col(at) / BUCKET))
    # pages do not overlap, so at most one span of the bucket holds the point: an outer join on the
    # range keeps every point exactly once
    hit = (
        (F.col("p." + doc) == F.col("s." + doc)) & (F.col("p.bucket") == F.col("s.bucket"))
        & (F.col(at) >= F.col("s.char_offset")) & (F.col(at) < F.col("s.char_end"))
    )
    found = probes.alias("p").join(spans.alias("s"), hit, "left").select("p.*", F.col("s.page_number").alias("hit_page"))
    last = pages.groupBy(doc).agg(
        F.max_by("page_number", "page_number").alias("last_page"),
        F.max_by("char_end", "page_number").alias("last_end"),
    )
    page = F.coalesce("hit_page", F.when(F.col(at) >= F.col("last_end"), F.col("last_page")))
    return found.join(last, doc, "left").withColumn("page_number", page).drop("hit_page", "last_page", "last_end", "bucket")


def pages_in_range(ranges: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(range row, page_number) for pages with offset < end_char and end > start_char.

    A pair is produced only in the bucket where the later of the two intervals starts, so no
    duplicate has to be removed afterwards.
    """
    wide = ranges.where(F.col("end_char") >= F.col("start_char"))
    left = _spread(wide, F.col("start_char"), F.greatest(F.col("start_char"), F.col("end_char")))
    right = _spread(pages, F.col("char_offset"), F.col("char_end")).select(
        doc, "bucket", "page_number", "char_offset", "char_end")
    joined = left.join(right, [doc, "bucket"])
    touch = (F.col("char_offset") < F.col("end_char")) & (F.col("char_end") > F.col("start_char"))
    owner = F.floor(F.greatest(F.col("start_char"), F.col("char_offset")) / BUCKET)
    return joined.where(touch & (F.col("bucket") == owner)).drop("bucket", "char_offset", "char_end")
