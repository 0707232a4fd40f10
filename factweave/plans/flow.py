"""The five stages as one lazy composition: split, relate, link, label, classify."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.vectors import embed, gram_counts
from ..operators import candidates, chunking, documents, labels, linking, relations, routing
from ..sources.checkpoints import checkpointed

LEXICON = [("is", "instance_of", "attribute", 0.8), ("was", "instance_of", "attribute", 0.78), ("with", "partner", "people", 0.9),
           ("from", "located_in", "place", 0.85), ("by", "owned_by", "ownership", 0.76)]


def parse_stages(text: str) -> frozenset[int]:
    """"1,2,3", "1-3" and "1-5" as a stage set; numbers above 5 are accepted and do nothing."""
    out: set[int] = set()
    for part in text.split(","):
        lo, _, hi = part.strip().partition("-")
        out.update(range(int(lo), int(hi or lo) + 1))
    return frozenset(s for s in out if s <= 5)


@dataclass(frozen=True)
class FlowConfig:
    """Defaults of every stage; providers are Column or DataFrame functions that can be replaced."""

    stages: frozenset[int] = frozenset({1, 2, 3, 4, 5})
    chunking: chunking.ChunkConfig = chunking.ChunkConfig()
    splitter: Callable[[Column], Column] = candidates.sentence_array
    lexicon: list = field(default_factory=lambda: LEXICON)
    min_confidence: float = relations.MIN_CONFIDENCE
    embedder: Callable[[Column], Column] = embed
    org_accept: float = linking.ACCEPT
    topic_min: float = 0.05
    typer: Callable[[Column, Column], Column] = lambda text, sentence: F.lit("UNKNOWN")  # entity type of a mention in its sentence
    linkers: tuple[routing.Linker, ...] = ()


def relate(sentences: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Stage 2: statements of sentences (all accepted relations) with a deterministic stmt_id."""
    found = relations.lexicon_relations(sentences, cfg.lexicon)
    kept = relations.accepted_relations(found, min_confidence=cfg.min_confidence)
    keys = [c for c in ("doc_id", "chunk_index", "sent_idx", "rel_idx") if c in kept.columns]
    return kept.select(
        F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys]), 256).alias("stmt_id"),
        *[c for c in ("doc_id", "chunk_index", "page_number", "sent_idx") if c in kept.columns],
        F.col("head").alias("subject"), cfg.typer(F.col("head"), F.col("sentence")).alias("subject_type"), "predicate", "predicate_category",
        F.col("tail").alias("object"), cfg.typer(F.col("tail"), F.col("sentence")).alias("object_type"), F.col("sentence").alias("source_text"), "confidence",
        F.lit("lexicon").alias("extraction_method"))


def link(statements: DataFrame, orgs: DataFrame, cfg: FlowConfig, people: DataFrame | None = None) -> DataFrame:
    """Stage 3: every mention's canonical entity, as (stmt_id, side, canonical_id, fqn, match_confidence).

    Each distinct look-up goes to the linkers of its type by priority: persons to people(person_id, name, role, org),
    organisations and untyped mentions to orgs(s_suppkey, s_name), then cfg.linkers. Results are joined back to the mentions.
    """
    mentions, lookups = routing.typed_lookups(statements, "stmt_id")
    linkers = [routing.organisation_linker(orgs, "s_suppkey", "s_name", cfg.embedder, cfg.org_accept), *cfg.linkers]
    if people is not None:
        linkers.append(routing.person_linker(people, "person_id", "name", "role", "org", cfg.embedder))
    found = routing.cascade(checkpointed(lookups), linkers)
    return mentions.join(found, "lookup_id").select("stmt_id", "side", "canonical_id", "fqn", "match_confidence")


def label(statements: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Stage 4: canonical names, sentiment, relation type and overall confidence."""
    out = labels.sentiment_label(labels.with_canonicals(statements, canonicals, "stmt_id"))
    return out.withColumns({
        "relation_type": F.col("predicate_category"),
        "overall_confidence": labels.confidence_label(F.col("confidence"), F.col("confidence"), F.col("confidence"), F.col("subject_match"), F.col("object_match")),
    })


def classify(statements: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Stage 5: topics, computed once per distinct source text."""
    names = [f"{c} {lab}" for c, lab in fixed.TAXONOMY_TABLE]
    run = labels.topic_classifier(gram_counts, fixed.TAXONOMY_TABLE, gram_counts(pd.Series(names)), min_score=cfg.topic_min)
    once = checkpointed(statements.select("source_text").distinct().withColumn("topics", run(F.col("source_text"))))
    return statements.join(once, "source_text", "left")


def run_stages(sentences: DataFrame, orgs: DataFrame, cfg: FlowConfig, people: DataFrame | None = None) -> DataFrame:
    """Labels need canonical entities: they are linked also if only stage 4 is asked for."""
    if 2 not in cfg.stages:
        return sentences
    # linking, labels and topics all read the statements; they are related once
    st = checkpointed(relate(sentences, cfg)) if cfg.stages & {3, 4} else relate(sentences, cfg)
    if 4 in cfg.stages:
        st = label(st, link(st, orgs, cfg, people))
    return classify(st, cfg) if 5 in cfg.stages else st


def text_statements(docs: DataFrame, orgs: DataFrame, cfg: FlowConfig = FlowConfig(), people: DataFrame | None = None) -> DataFrame:
    s = candidates.split_sentences(docs, "text", cfg.splitter).drop("text")
    out = run_stages(s, orgs, cfg, people)
    return _flat_topics(out)


def document_statements(pages: DataFrame, orgs: DataFrame, cfg: FlowConfig = FlowConfig(), people: DataFrame | None = None) -> DataFrame:
    chunks = chunking.chunk_pages(pages, "doc_id", cfg.chunking).withColumn("page_number", chunking.primary_page(F.col("page_numbers")))
    s = candidates.split_sentences(chunks.select("doc_id", "chunk_index", "page_number", "text"), "text", cfg.splitter).drop("text")
    s = documents.cross_chunk_dedup(s, "doc_id", "sentence", [F.asc("chunk_index"), F.asc("sent_idx")])
    out = run_stages(s, orgs, cfg, people)
    cited = out.withColumn("citation", tx.citation(
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.array().cast("array<string>"), F.lit(None).cast("int"), F.col("page_number")))
    return _flat_topics(cited)


def _flat_topics(df: DataFrame) -> DataFrame:
    if "topics" not in df.columns:
        return df
    line = F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["category"], x["label"], F.format_string("%.4f", x["confidence"]))), "; ")
    return df.withColumn("topics", line)
