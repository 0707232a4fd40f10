"""Documents from fetched URLs: one pass, two typed outputs (documents, and rejected URLs with the reason)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.html import extract_pages, meaningful
from .checkpoints import checkpointed
from .documents import fetch

NO_TEXT = "No meaningful content extracted from HTML"
CHALLENGE = "CAPTCHA or challenge page"
PDF = b"%PDF-"
_COMMON = ["url", "final_url", "source_type", "title", "author", "published_date", "description", "pages", "error"]
_PDF_SCHEMA = "url string, final_url string, source_type string, title string, author string, published_date string, description string, pages array<string>, error string"


def routed(fetched: DataFrame) -> DataFrame:
    """Fetched rows (url, final_url, content binary, header, error) with `route` pdf or html: by header, then URL, and what is
    still open by the content's first bytes. Bytes that are no UTF-8 are replaced in `html`, never an error. A challenge
    page that is routed as HTML gets an error."""
    kind = tx.content_type(F.col("header"), F.coalesce("final_url", "url"))
    sniffed = F.when(F.substring("content", 1, len(PDF)) == F.lit(PDF), "pdf").otherwise("html")
    route = F.when(kind.isin("pdf", "html"), kind).otherwise(sniffed)
    out = fetched.withColumn("route", route).withColumn("html", F.when(F.col("route") == "html", F.make_valid_utf8(F.col("content").cast("string"))))
    return out.withColumn("error", F.coalesce("error", F.when(tx.is_captcha(F.col("html")), CHALLENGE)))


def _web(rows: DataFrame, open_references: bool) -> DataFrame:
    parts = extract_pages(rows.select("url", "final_url", "html"), "html", open_references)
    return parts.select("url", "final_url", F.lit("webpage").alias("source_type"), F.coalesce("meta_title", tx.blank_to_null(F.col("title"))).alias("title"), "author", "published_date",
                        "description", F.array("text").alias("pages"), F.when(~meaningful(F.col("text")), NO_TEXT).alias("error"))


def _pdfs(rows: DataFrame, parser: Callable[[bytes], tuple[list[str], dict]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, final, content in zip(pdf["url"], pdf["final_url"], pdf["content"]):
                pages, meta, error = None, {}, None
                try:
                    pages, meta = parser(bytes(content) if content is not None else b"")
                    if not pages:
                        error = "Failed to parse PDF: no pages"
                except Exception as e:  # a file that cannot be read is a result, not a job failure
                    error = f"Failed to parse PDF: {e}"
                out.append((url, final, "pdf", meta.get("title") or None, meta.get("author") or None, None, None, [p.strip() for p in pages] if pages else None, error))
            yield pd.DataFrame(out, columns=_COMMON)

    return rows.select("url", "final_url", "content").mapInPandas(run, _PDF_SCHEMA)


def load_fetched(fetched: DataFrame, pdf_parser: Callable[[bytes], tuple[list[str], dict]], open_references: bool = True) -> DataFrame:
    """(url, final_url, source_type, title, author, published_date, description, pages, error) of every fetched row, written once.

    A row with an error is a rejected one: what could not be fetched, challenge pages, web pages with less than 50
    characters of text, PDFs the parser cannot read. `documents` and `rejected` read the written rows. Columns beyond
    url, final_url, content, header and error are not read; repeated URLs stay repeated rows.
    open_references: see `extract_pages`.
    """
    rows = routed(checkpointed(fetched.select("url", "final_url", "content", "header", "error")))
    fine = rows.where(F.col("error").isNull())
    failed = rows.where(F.col("error").isNotNull()).select("url", "final_url", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("source_type", "string"), ("title", "string"), ("author", "string"), ("published_date", "string"), ("description", "string"), ("pages", "array<string>"))], "error")
    done = _web(fine.where(F.col("route") == "html"), open_references).unionByName(_pdfs(fine.where(F.col("route") == "pdf"), pdf_parser)).unionByName(failed)
    return checkpointed(done.select(*_COMMON))


def load_urls(urls: DataFrame, fetcher: Callable[[str], tuple], pdf_parser: Callable[[bytes], tuple[list[str], dict]], url: str = "url") -> DataFrame:
    """Fetches urls(url) with a provider and loads what came; see `load_fetched`."""
    return load_fetched(fetch(urls, fetcher, url), pdf_parser)


def documents(loaded: DataFrame) -> DataFrame:
    """The loaded rows that became documents, with the number of pages."""
    return loaded.where(F.col("error").isNull()).drop("error").withColumn("page_count", F.size("pages"))


def rejected(loaded: DataFrame) -> DataFrame:
    """(url, final_url, reason) of the rest."""
    return loaded.where(F.col("error").isNotNull()).select("url", "final_url", F.col("error").alias("reason"))
