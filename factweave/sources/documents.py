"""Readers: text files, pages, web pages through a fetch provider, PDFs, predicate and taxonomy files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators.html import extract_pages, meaningful

FETCHED = "url string, final_url string, content binary, header string, error string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, stripped."""
    return spark.read.text(path, wholetext=True).select(tx.strip(F.col("value")).alias("text"), F.input_file_name().alias("path"))


def page_rows(conversations: DataFrame) -> DataFrame:
    """Conversation turns as pages of a document (turn 0 is page 1)."""
    return conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text", "role")


def fetch(urls: DataFrame, fetcher: Callable[[str], tuple], url: str = "url", attempts: int = 3) -> DataFrame:
    """Fetches urls inside tasks with a provider `url -> (final_url, content, content_type_header)`.

    An exception is retried up to `attempts` times, then kept as the row's error.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf["url"]:
                error, got = None, (None, None, None)
                for _ in range(attempts):
                    try:
                        got, error = fetcher(u), None
                        break
                    except Exception as e:  # a failed fetch is a result, not a job failure
                        error = str(e)
                rows.append((u, got[0], got[1], got[2], error))
            yield pd.DataFrame(rows, columns=["url", "final_url", "content", "header", "error"])

    return urls.select(F.col(url).alias("url")).mapInPandas(run, FETCHED)


def classify_fetched(df: DataFrame) -> DataFrame:
    """content_type of fetched rows; unknown content that starts with %PDF- is a PDF, the rest HTML.
    Challenge pages become errors."""
    kind = tx.content_type(F.col("header"), F.coalesce("final_url", "url"))
    sniff = F.when(F.substring(F.col("content").cast("string"), 1, 5) == "%PDF-", "pdf").otherwise("html")
    html = F.decode(F.col("content"), "UTF-8") if dict(df.dtypes)["content"] == "binary" else F.col("content")
    out = df.withColumn("content_type", kind).withColumn("route", F.when(F.col("content_type").isin("pdf", "html"), F.col("content_type")).otherwise(sniff))
    return out.withColumn("error", F.coalesce("error", F.when(tx.is_captcha(html), "CAPTCHA or challenge page")))


def load_html(df: DataFrame, html: str = "html", open_references: bool = True) -> DataFrame:
    """Web documents (one page each): title, text, author, metadata; error when there is no real text."""
    out = extract_pages(df, html, open_references)
    error = F.when(~meaningful(F.col("text")), "No meaningful content extracted from HTML")
    return out.withColumns({
        "source_type": F.lit("webpage"), "doc_title": F.coalesce("meta_title", tx.blank_to_null(F.col("title"))),
        "error": F.coalesce("error", error) if "error" in df.columns else error,
    })


def read_pdfs(spark: SparkSession, path: str, parser: Callable[[bytes], tuple[list[str], dict]]) -> DataFrame:
    """(path, page_number, text, metadata) of PDF files through a parser provider run in tasks."""
    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                pages, meta = parser(bytes(content))
                rows.extend((p, i + 1, t.strip(), {k: str(v) for k, v in meta.items() if v}) for i, t in enumerate(pages))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "metadata"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page_number int, text string, metadata map<string,string>")


def pdf_metadata(raw: Column) -> Column:
    """Known PDF metadata keys renamed, blank values dropped, values stripped."""
    names = F.create_map(*[F.lit(x) for kv in fixed.PDF_METADATA_KEYS.items() for x in kv])
    kept = F.map_filter(raw, lambda k, v: F.map_contains_key(names, k) & (tx.strip(F.coalesce(v, F.lit(""))) != ""))
    return F.transform_values(F.transform_keys(kept, lambda k, _: F.element_at(names, k)), lambda _, v: tx.strip(v))


def read_predicate_lines(spark: SparkSession, path: str) -> DataFrame:
    """Predicate list file: one per line, blanks and # comments skipped."""
    lines = spark.read.text(path).select(tx.strip(F.col("value")).alias("predicate"))
    return lines.where((F.col("predicate") != "") & ~F.col("predicate").startswith("#"))


def read_predicate_json(spark: SparkSession, path: str) -> DataFrame:
    """(category, predicate, description, threshold) of a category -> predicate -> settings file."""
    body = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string, map<string, struct<description: string, threshold: double>>>").alias("m"))
    cats = body.select(F.explode("m").alias("category", "preds"))
    return cats.select("category", F.explode("preds").alias("predicate", "cfg")).select("category", "predicate", "cfg.*")


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """(category, label, label_id, description, mnli_label, embedding_label) of a taxonomy file."""
    entry = "struct<description: string, id: int, mnli_label: string, embedding_label: string>"
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, {entry}>>").alias("m"))
    cats = body.select(F.explode("m").alias("category", "labels"))
    return cats.select("category", F.explode("labels").alias("label", "e")).select(
        "category", "label", F.col("e.id").alias("label_id"), "e.description", "e.mnli_label", "e.embedding_label")


def dim(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A fixed table (from_list of predicates, authored taxonomy) as a DataFrame."""
    return spark.createDataFrame(rows, names)
