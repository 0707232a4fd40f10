"""Small command line: python -m factweave <split|chunk|statements> <text path> [--format json|csv] [--out folder]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import candidates, chunking, relations
from .plans.flow import FlowConfig, parse_stages, relate
from .sources.documents import read_texts


def main() -> None:
    p = argparse.ArgumentParser(prog="factweave")
    p.add_argument("command", choices=["split", "chunk", "statements"])
    p.add_argument("path")
    p.add_argument("--target-tokens", type=int, default=1000)
    p.add_argument("--stages", default="1-5")
    p.add_argument("--format", choices=["json", "csv", "show"], default="show")
    p.add_argument("--out")
    a = p.parse_args()
    spark = SparkSession.builder.appName("factweave").getOrCreate()
    docs = read_texts(spark, a.path).select(F.sha2("path", 256).alias("doc_id"), "text")
    if a.command == "chunk":
        cfg = chunking.ChunkConfig(target_tokens=a.target_tokens, max_tokens=2 * a.target_tokens)
        out = chunking.chunk_texts(docs, "doc_id", "text", cfg).withColumn("page_numbers", F.array_join("page_numbers", ","))
    else:
        out = candidates.split_sentences(docs).drop("text")
        if a.command == "statements" and 2 in parse_stages(a.stages):
            out = relate(out, FlowConfig(min_confidence=relations.MIN_CONFIDENCE))
    if a.out and a.format != "show":
        out.write.format(a.format).option("header", True).save(a.out)
    else:
        out.show(50, truncate=100)


if __name__ == "__main__":
    main()
