"""From documents to packed training sequences, in five stages. Each stage's rows are written as Parquet and read back as
the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import jaccard, langid, mixing, packing, pii
from factweave.llm.common import tokenizer_path, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, and those whose bits lie too far from every
    language's codeword to be mended, are rejected. The model learns from the documents that are not held out."""
    model = langid.learn(docs.where(~langid.fold()))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("row"))  # as one column, so that no name clashes
    told = langid.identify(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return told.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id, of those with it (or without any)
    the smallest key. Each row has a key of its own for this, a hash of id and text; rows that are equal in both count once.
    Only ids and keys are made distinct for that: texts move once, when the kept ones are taken."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())
    ids = docs.select(key.alias("__key"), F.col("doc_id").alias("__id")).dropDuplicates(["__key"])
    of = jaccard.join(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    best = F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__key").alias("key")))
    first = of.join(ids, "__key").groupBy("component_id").agg(best.alias("b")).select(F.col("b.key").alias("__key"))
    kept = docs.withColumn("__key", key).join(first, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, each span of personal data replaced by its kind."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of all sources to target weights takes, a document as often as it is taken."""
    return mixing.mixed(docs.withColumn("__words", mixing.word_count()), "__words").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 ids."""
    # a smaller store of words than where packing is all that a worker does
    pieces = packing.pack(packing.cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), store=100_000))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mix_sources", mixed_sources),
    ("pack_sequences", packed),
]

# SQL can express neither the learned stages nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
