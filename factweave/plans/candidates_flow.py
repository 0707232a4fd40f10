"""Candidate answers to final statements: parse, score, merge beams, de-duplicate, best per source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import best_in_context
from ..operators import candidates, dedup, evidence, scoring
from ..sources.checkpoints import checkpointed


@dataclass(frozen=True)
class ExtractionOptions:
    """Options of the single-call extraction; `mentions` is an NER provider Column for entity scores."""

    min_statement_ratio: float = 1.0
    merge_beams: bool = True
    embedding_dedup: bool = True
    all_triples: bool = False
    predicates: tuple[str, ...] = ()
    predicate_threshold: float = 0.5
    dedup_threshold: float = 0.65
    scoring: scoring.ScoringConfig = scoring.ScoringConfig()
    mentions: Column | None = None


def statements_from_candidates(answers: DataFrame, docs: DataFrame, opt: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """Statements of documents (doc_id, text) from model answers (doc_id, attempt, beam, xml).

    A beam is identified by (attempt, beam); `seq` orders its statements. All attempts up to the first
    sufficient one are pooled, as the answers of later attempts are only asked for when needed.
    """
    need = docs.select("doc_id", F.col("text").alias("__text"), tx.min_expected_statements(F.col("text"), opt.min_statement_ratio).alias("expected"))
    rows = candidates.parse_statements_xml(answers, "xml").drop("xml").where(F.col("predicate") != "")
    rows = candidates.sufficient_attempts(rows.join(need, "doc_id"), ["doc_id"], "attempt", "expected").drop("expected")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    rows = rows.withColumns({"beam": F.concat(pad("attempt"), pad("beam")), "seq": pad("stmt_idx"), "extraction_method": F.lit("model")}).drop("attempt", "stmt_idx")

    c = F.col
    ments = opt.mentions if opt.mentions is not None else F.array().cast("array<struct<text:string,confidence:double>>")
    score = scoring.triple_score(c("subject"), c("predicate"), c("object"), F.coalesce("source_text", "__text"),
                                 scoring.entity_score(c("subject"), ments), scoring.entity_score(c("object"), ments))
    # several branches below read these rows: parsing and scoring are done once and kept in the checkpoint folder
    scored = checkpointed(rows.withColumns({"confidence": F.round(score, 9)}).drop("__text"))

    spans = evidence.evidence_spans(docs, scored, "doc_id", "text", ["beam", "seq"])
    cover = evidence.coverage(spans, docs, "doc_id", ["beam"], "text")
    beams = scoring.beam_score(scoring.beam_stats(scored, ["doc_id", "beam"]).join(cover, ["doc_id", "beam"], "left"), opt.scoring)
    if opt.merge_beams:
        out = scoring.merge_beams(scored, beams, ["doc_id"], "beam", "seq", opt.scoring)
        out = out.withColumn("seq", F.concat(F.lpad(c("position.beam_rank").cast("string"), 2, "0"), "position.seq")).drop("position")
    else:
        out = scored.join(scoring.best_beam(beams, ["doc_id"], "beam").select("doc_id", "beam"), ["doc_id", "beam"])
    if opt.embedding_dedup:
        out = dedup.semantic_dedup(out, ["doc_id"], "seq", opt.dedup_threshold)
        out = out.withColumn("seq", c("position")).drop("position")
    if opt.predicates:
        best = best_in_context(list(opt.predicates))
        ref = tx.lower_strip(F.coalesce("source_text", F.concat_ws(" ", "subject", "predicate", "object")))
        out = out.withColumn("__m", best(c("subject"), c("object"), ref)).withColumn(
            "canonical_predicate", F.when(c("__m.similarity") >= opt.predicate_threshold, c("__m.candidate"))).drop("__m")
    return out if opt.all_triples else scoring.best_per_source(out, ["doc_id"], [F.asc("seq")])
