"""Document assembly, provenance, counts and summary input."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .dedup import exact_dedup

PER_ROW = 4_096  # source texts of a document that meet its sentences in one row
FEW = 64  # sentences that are sought one by one


def text_documents(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Document records of plain texts: source_type is always "text"."""
    return df.select(F.col(doc).alias("doc_id"), F.col(text).alias("full_text"), F.lit("text").alias("source_type"),
                     F.length(text).alias("char_count"), F.lit(0).alias("page_count"))


def page_documents(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Document records of page tables: counts only, so a document never has to fit in one row."""
    return pages.groupBy(doc).agg(
        (F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("char_count"), F.count(F.lit(1)).alias("page_count"))


def join_pages(pages: DataFrame, doc: str = "doc_id", text: str = "text", sep: str = "\n") -> DataFrame:
    """(doc, full_text) of every document, its pages in order. The text is one value of one row by definition; the other
    operators here work on page rows, where a document may be of any length."""
    return pages.groupBy(doc).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("page_number", text))), lambda s: s[text]), sep).alias("full_text"))


def dedup_counts(sentences: DataFrame, doc: str, text: str) -> DataFrame:
    """Per document: sentences before and after removing repeated normalised texts across chunks."""
    before = sentences.groupBy(doc, tx.norm_key(F.col(text)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return before.groupBy(doc).agg(F.sum("n").alias("pre_dedup"), F.count(F.lit(1)).alias("post_dedup")).withColumn(
        "duplicates_removed", F.col("pre_dedup") - F.col("post_dedup"))


def cross_chunk_dedup(sentences: DataFrame, doc: str, text: str, order: list[Column]) -> DataFrame:
    return exact_dedup(sentences, [doc], [text], order)


def first_contained(sources: list[str], sentences: list[str]) -> list[int | None]:
    """For each source the smallest index of a sentence that it contains. Where the sentences are few they are tried in turn; else
    one pass over a source finds all of them."""
    if len(sentences) <= FEW:
        return [next((i for i, s in enumerate(sentences) if s in source), None) for source in sources]
    automaton = ahocorasick.Automaton()
    for i in range(len(sentences) - 1, -1, -1):  # of equal sentences the first one stays
        automaton.add_word(sentences[i], i)
    automaton.make_automaton()
    return [min((i for _, i in automaton.iter(source)), default=None) for source in sources]


def provenance(statements: DataFrame, sentences: DataFrame, doc: str, source: str, sentence: str, order: str) -> DataFrame:
    """First sentence of the document contained in each distinct source text (doc, source, order, sentence).

    A document's sentences meet its source texts once (PER_ROW of these at a time, so that a document with many is several
    rows): nothing is indexed or moved for each character of a text.
    """
    first = sentences.where(F.length(sentence) > 0).groupBy(doc, sentence).agg(F.min(order).alias(order))
    known = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, sentence))).alias("__known"))
    given = statements.where(F.length(source) > 0).select(doc, source).distinct()
    many = given.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PER_ROW).select(doc, F.ceil(F.col("__n") / PER_ROW).alias("__rows"))
    cut = given.join(many, doc, "left").withColumn("__slot", F.pmod(F.xxhash64(source), F.coalesce("__rows", F.lit(1))))
    work = cut.groupBy(doc, "__slot").agg(F.collect_list(source).alias("__given")).join(known, doc).select(doc, "__given", "__known")
    schema = T.StructType([statements.schema[doc], statements.schema[source], sentences.schema[order], sentences.schema[sentence]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts, known = batch.column(1)[row].values, batch.column(2)[row].values
                at = pa.array(first_contained(texts.to_pylist(), known.field(1).to_pylist()), pa.int64())
                hit, at = at.is_valid(), at.drop_null()
                owner = pa.array([row] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), texts.filter(hit), known.field(0).take(at), known.field(1).take(at)], names=schema.names)

    return work.mapInArrow(find, schema)


def stage_timings(events: DataFrame, keys: list[str], stage: str, seconds: str) -> DataFrame:
    return events.groupBy(*keys, stage).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("runs"))


def merged_logs(logs: DataFrame, doc: str, stage: str, seconds: str, level: str, message: str, order: list[str]) -> DataFrame:
    """(doc, timings map<stage,seconds>, errors, warnings) of the contexts of a document's chunks: times of a stage add up,
    messages follow each other in `order`. Times are added before the rows of a document come together; its
    messages are one list by definition. Rows without a stage or without a message only count for the other."""
    times = logs.where(F.col(stage).isNotNull()).groupBy(doc, stage).agg(F.sum(seconds).alias("__s"))
    timings = times.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stage, "__s")))).alias("timings"))
    said = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col(level) == kind, F.struct(*order, message)))), lambda m: m[message])
    told = logs.where(F.col(message).isNotNull()).groupBy(doc).agg(said("error").alias("errors"), said("warning").alias("warnings"))
    return timings.join(told, doc, "full")


def statements_by(statements: DataFrame, doc: str, part: str) -> DataFrame:
    """Statements of each page or chunk (`part`) of a document, counted; a statement without one is in none of them."""
    return statements.where(F.col(part).isNotNull()).groupBy(doc, part).agg(F.count(F.lit(1)).alias("statements"))


def context_dict(docs: DataFrame, statements: DataFrame, logs: DataFrame, doc: str, chunk: str, order: list[str], fields: list[str]) -> DataFrame:
    """(doc, context) of docs(doc, title, summary, duplicates_removed): the JSON form of a document's context with all its
    statements(doc, chunk, *order, *fields) in `order` and its `merged_logs`. Absent ones are empty lists."""
    # a distinct count would send every statement through a second shuffle
    per = statements.groupBy(doc).agg(
        F.size(F.collect_set(chunk)).cast("long").alias("chunk_count"), F.count(F.lit(1)).alias("statement_count"),
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("__f")))), lambda s: s["__f"]).alias("statements"))
    out = docs.join(per, doc, "left").join(logs, doc, "left")
    none = F.array()
    return out.select(doc, F.to_json(F.struct(
        F.col(doc).alias("document_id"), F.col("title").alias("document_title"), "summary", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("statement_count", F.lit(0)).alias("statement_count"), "duplicates_removed", F.coalesce("statements", none).alias("statements"),
        F.coalesce("timings", F.create_map().cast("map<string,bigint>")).alias("timings"), F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings")),
        {"ignoreNullFields": "false"}).alias("context"))


def summary_input(c: Column, max_tokens: int = 10_000, buffer: float = 0.95, keep: float = 0.7) -> Column:
    """Text cut to about max_tokens: by characters per token, then back to the last ". " or newline
    if that keeps more than 70 %."""
    tokens = tx.token_count(c)
    target = (max_tokens * (F.length(c) / tokens) * buffer).cast("int")
    cut = F.substring(c, F.lit(1), target)
    mark = F.length(F.regexp_extract(cut, r"(?s)^(.*)\. ", 1))
    line = F.length(F.regexp_extract(cut, r"(?s)^(.*)\n", 1))
    has_mark, has_line = cut.contains(". "), cut.contains("\n")
    at = F.greatest(F.when(has_mark, mark).otherwise(-1), F.when(has_line, line).otherwise(-1))
    return F.when(tokens <= max_tokens, c).when(at > target * keep, F.substring(cut, F.lit(1), at + 1)).otherwise(cut)
