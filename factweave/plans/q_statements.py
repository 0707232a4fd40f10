"""Catalogue: candidate statements, beams, scoring, de-duplication, predicates and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.vectors import best_in_context, best_of, text_cosine
from ..operators import candidates, dedup, documents, evidence, relations, scoring
from ..sources.checkpoints import checkpointed
from .derived import SENTENCES_SQL, WS, sql_norm, statements, statements_sql
from .registry import query
from .sql import gram_sql, similarity_sql

ST = statements_sql()
ST_SUPP = statements_sql("l_suppkey")
TRIPLE = "subject, subject_type, predicate, object, object_type, source_text, confidence"
COLS = [c.strip() for c in TRIPLE.split(",")]


# ---- statements ------------------------------------------------------------------------------

@query("statement_triples", f"WITH {ST} SELECT doc_id, seq, {TRIPLE} FROM st")
def statement_triples(t):
    return statements(t).select("doc_id", "seq", *COLS)


def _first(part: str, order: str, cte: str = ST_SUPP, cols: str = "doc_id, seq, " + TRIPLE) -> str:
    return f"WITH {cte}, r AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM st) SELECT {cols} FROM r WHERE rn = 1"


@query("exact_dedup", _first(f"doc_id, {sql_norm('subject')}, {sql_norm('predicate')}, {sql_norm('object')}", "seq"))
def exact_dedup(t):
    return dedup.exact_dedup(statements(t, "l_suppkey"), ["doc_id"], ["subject", "predicate", "object"], [F.asc("seq")]).select("doc_id", "seq", *COLS)


@query("interface_dedup", _first("lower(subject) || '|||' || lower(predicate) || '|||' || lower(object)", "seq", ST))
def interface_dedup(t):
    df = statements(t).withColumn("k", dedup.ui_key(F.col("subject"), F.col("predicate"), F.col("object")))
    from ..operators.ranking import first_per_key
    return first_per_key(df, ["k"], [F.asc("seq")]).select("doc_id", "seq", *COLS)


@query("sentence_dedup", f"WITH {SENTENCES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_norm('sentence')} ORDER BY sent_idx) AS rn FROM sents) SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, sentence FROM r WHERE rn = 1")
def sentence_dedup(t):
    s = candidates.split_sentences(t.documents.select("doc_id", "text")).drop("text")
    return documents.cross_chunk_dedup(s, "doc_id", "sentence", [F.asc("sent_idx")]).select("doc_id", "sent_idx", "sentence")


@query("dedup_counts", f"WITH {SENTENCES_SQL} SELECT doc_id, count(*) AS pre_dedup, count(DISTINCT {sql_norm('sentence')}) AS post_dedup, count(*) - count(DISTINCT {sql_norm('sentence')}) AS duplicates_removed FROM sents GROUP BY 1")
def dedup_counts(t):
    return documents.dedup_counts(candidates.split_sentences(t.documents.select("doc_id", "text")).drop("text"), "doc_id", "sentence")


_SOURCED = "CASE WHEN beam < 3 THEN source_text END"


@query("best_per_source", f"""WITH {ST_SUPP}, x AS (SELECT * REPLACE ({_SOURCED} AS source_text) FROM st), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_text ORDER BY confidence DESC, seq) AS rn FROM x)
  SELECT doc_id, seq, {TRIPLE} FROM r WHERE rn = 1 OR source_text IS NULL""")
def best_per_source(t):
    """The best statement of each source text; one beam's statements have no source text and are all kept."""
    df = statements(t, "l_suppkey").withColumn("source_text", F.expr(_SOURCED))
    return scoring.best_per_source(df, ["doc_id"], [F.asc("seq")]).select("doc_id", "seq", *COLS)


@query("ranked_statements", f"WITH {ST_SUPP}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, seq) AS INTEGER) AS rank FROM st) SELECT doc_id, rank, seq, subject, predicate, object, confidence FROM r")
def ranked_statements(t):
    return scoring.ranked_statements(statements(t, "l_suppkey"), ["doc_id"], [F.asc("seq")]).select(
        "doc_id", "rank", "seq", "subject", "predicate", "object", "confidence")


_SUPPORT = f"len(list_filter(regexp_split_to_array(lower(predicate), '{WS}+'), lambda w: length(w) > 2 AND contains(lower(source_text), w))) > 0"


@query("predicate_support", f"WITH {ST} SELECT doc_id, seq, predicate, source_text, {_SUPPORT} AS supported FROM st")
def predicate_support(t):
    return statements(t).select("doc_id", "seq", "predicate", "source_text", scoring.predicate_supported(F.col("predicate"), F.col("source_text")).alias("supported"))


# ---- beams -----------------------------------------------------------------------------------

# A document's text is its source texts, each once, and some words that no statement speaks of. Low confidences count as given
# or not given, so that some statements are scored anew.
_CONFIDENCE = "CASE WHEN confidence <= 0.28 THEN CASE WHEN confidence <= 0.2 THEN 0.0 END ELSE confidence END"
BEAM_SQL = f"""{ST.replace("st AS (", "st_ AS (", 1)}, st AS MATERIALIZED (SELECT * REPLACE ({_CONFIDENCE} AS confidence) FROM st_),
  bd AS (SELECT doc_id, string_agg(DISTINCT source_text, ' ' ORDER BY source_text) || ' and nothing else' AS text FROM st GROUP BY 1),
  {similarity_sql("SELECT source_text AS a, subject || ' ' || predicate || ' ' || object AS b FROM st WHERE coalesce(confidence, 0) = 0")},
  qu AS (SELECT st.*, CASE WHEN coalesce(confidence, 0) <> 0 THEN confidence ELSE round(0.5 * s + 0.25 * 0.2 + 0.25 * 0.2, 9) END AS quality
    FROM st LEFT JOIN sim ON coalesce(confidence, 0) = 0 AND a = source_text AND b = subject || ' ' || predicate || ' ' || object),
  tri AS (SELECT doc_id, beam, lower(subject) AS s, lower(predicate) AS p, lower(object) AS o, count(*) AS c, sum(quality) AS q FROM qu GROUP BY ALL),
  bs AS (SELECT doc_id, beam, CAST(sum(c) AS BIGINT) AS n, sum(q) AS quality_sum, CASE WHEN sum(c) < 2 THEN 0.0 ELSE sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) END AS redundancy FROM tri GROUP BY ALL),
  bsp AS (SELECT DISTINCT doc_id, beam, strpos(lower(text), lower(source_text)) - 1 AS a, strpos(lower(text), lower(source_text)) - 1 + length(source_text) AS e FROM st JOIN bd USING (doc_id)),
  bch AS (SELECT doc_id, pos FROM (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, '') AS c FROM bd)) WHERE NOT regexp_matches(ch, '{WS}')),
  bct AS (SELECT doc_id, count(*) AS total FROM bch GROUP BY 1), bhit AS (SELECT doc_id, beam, count(DISTINCT pos) AS h FROM bsp JOIN bch USING (doc_id) WHERE pos >= a AND pos < e GROUP BY ALL),
  sc AS (SELECT bs.*, coalesce(h, 0) / total AS coverage, round(quality_sum + 0.5 * (coalesce(h, 0) / total) - 0.3 * redundancy - 0.1 * (n / 10.0), 9) AS score
    FROM bs JOIN bct USING (doc_id) LEFT JOIN bhit USING (doc_id, beam))"""


def _beam_statements(t):
    """Statements with their beams, read by several branches: kept in the checkpoint folder."""
    return checkpointed(statements(t).withColumn("confidence", F.expr(_CONFIDENCE)))


def _beam_documents(df):
    text = F.concat(F.array_join(F.array_sort(F.collect_set("source_text")), " "), F.lit(" and nothing else"))
    return df.groupBy("doc_id").agg(text.alias("text"))


def _scored_beams(df):
    docs = _beam_documents(df)
    spans = evidence.evidence_spans(docs, df, "doc_id", "text", ["beam", "seq"])
    cover = evidence.coverage(spans, docs, "doc_id", ["beam"], "text")
    stats = scoring.beam_stats(scoring.rescored(df, docs, "doc_id", "text"), ["doc_id", "beam"], F.col("quality"))
    return scoring.beam_score(stats.join(cover, ["doc_id", "beam"], "left"))


@query("beam_redundancy", f"WITH {BEAM_SQL} SELECT doc_id, beam, n, round(redundancy, 4) AS redundancy FROM bs")
def beam_redundancy(t):
    return scoring.beam_stats(statements(t), ["doc_id", "beam"]).select("doc_id", "beam", "n", F.round("redundancy", 4).alias("redundancy"))


@query("beam_scores", f"WITH {BEAM_SQL} SELECT doc_id, beam, n, round(quality_sum, 6) AS quality_sum, round(coverage, 6) AS coverage, round(score, 6) AS score FROM sc")
def beam_scores(t):
    """Quality with statements scored anew where no confidence is given, coverage, redundancy and length of each beam."""
    return _scored_beams(_beam_statements(t)).select(
        "doc_id", "beam", "n", F.round("quality_sum", 6).alias("quality_sum"), F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


@query("best_beam", f"WITH {BEAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, beam) AS rn FROM sc) SELECT doc_id, beam, n, round(score, 6) AS score FROM r WHERE rn = 1")
def best_beam(t):
    return scoring.best_beam(_scored_beams(_beam_statements(t)), ["doc_id"], "beam").select("doc_id", "beam", "n", F.round("score", 6).alias("score"))


@query("merge_beams", f"""WITH {BEAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, beam) AS br FROM sc),
  pool AS (SELECT st.*, br FROM st JOIN r ON r.doc_id = st.doc_id AND r.beam = st.beam AND br <= 3 WHERE confidence >= 0.3 AND {_SUPPORT}),
  w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(subject), lower(predicate), lower(object) ORDER BY confidence DESC, br, seq) AS rn,
    first_value(seq) OVER (PARTITION BY doc_id, lower(subject), lower(predicate), lower(object) ORDER BY br, seq) AS first_seq FROM pool)
  SELECT doc_id, beam, subject, predicate, object, source_text, confidence, seq, first_seq FROM w WHERE rn = 1""")
def merge_beams(t):
    df = _beam_statements(t)
    merged = scoring.merge_beams(df, _scored_beams(df), ["doc_id"], "beam", "seq", scoring.ScoringConfig(min_confidence=0.3))
    return merged.select("doc_id", "beam", "subject", "predicate", "object", "source_text", "confidence", "seq", F.col("position.seq").alias("first_seq"))


@query("sufficient_attempts", f"""WITH {ST_SUPP}, x AS (SELECT doc_id, attempt, count(*) AS n FROM st GROUP BY ALL), need AS (SELECT s_suppkey AS doc_id, CAST(s_nationkey * 12 AS BIGINT) AS need FROM supplier),
  stop AS (SELECT doc_id, min(attempt) AS stop_at FROM x JOIN need USING (doc_id) WHERE n >= need GROUP BY 1)
  SELECT doc_id, st.attempt, count(*) AS kept FROM st LEFT JOIN stop USING (doc_id) WHERE stop_at IS NULL OR st.attempt <= stop_at GROUP BY ALL""")
def sufficient_attempts(t):
    need = t.supplier.select(F.col("s_suppkey").alias("doc_id"), (F.col("s_nationkey") * 12).cast("long").alias("expected"))
    df = statements(t, "l_suppkey").join(need, "doc_id")
    return candidates.sufficient_attempts(df, ["doc_id"], "attempt", "expected").groupBy("doc_id", "attempt").agg(F.count(F.lit(1)).alias("kept"))


# ---- candidate XML ---------------------------------------------------------------------------

def _x(tag: str, v: str, kind: str | None = None) -> str:
    attr = f"CASE WHEN {kind} = 'UNKNOWN' THEN '' ELSE ' type=\"' || {kind} || '\"' END" if kind else "''"
    return f"'<{tag}' || {attr} || '>' || replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{tag}>'"


STMT_SQL = f"'<stmt>' || {_x('subject', 'subject', 'subject_type')} || {_x('object', 'object', 'object_type')} || {_x('predicate', 'predicate')} || {_x('text', 'source_text')} || '</stmt>'"


@query("statement_xml", f"WITH {ST} SELECT doc_id, seq, '<statements>' || {STMT_SQL} || '</statements>' AS xml FROM st")
def statement_xml(t):
    return _with_xml(statements(t)).select("doc_id", "seq", "xml")


def _with_xml(df):
    one = candidates.statement_xml(*[F.col(c) for c in COLS[:6]])
    return df.withColumn("xml", F.concat(F.lit("<statements>"), one, F.lit("</statements>")))


@query("longest_candidate", f"WITH {ST_SUPP}, x AS (SELECT doc_id, seq, '<statements>' || {STMT_SQL} || '</statements>' AS xml FROM st), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(xml) DESC, seq) AS rn FROM x) SELECT doc_id, xml FROM r WHERE rn = 1")
def longest_candidate(t):
    return candidates.longest_candidate(_with_xml(statements(t, "l_suppkey")), ["doc_id"], "xml", ["seq"]).select("doc_id", "xml")


_OTHER = "<stmt><subject>nobody</subject><object>x</object><predicate>y</predicate></stmt>"
_LOUD = f"replace({STMT_SQL}, subject, upper(subject))"
ANSWERS_SQL = f"""x AS (SELECT doc_id, seq, attempt, CASE beam WHEN 0 THEN '<statements>' || {STMT_SQL} || '</statements>' WHEN 1 THEN '<statements>' || {STMT_SQL} || '{_OTHER}</statements>'
    WHEN 2 THEN '<answers>' || {STMT_SQL} || {STMT_SQL} || '</answers>' ELSE '<statements>' || {STMT_SQL} || {_LOUD} END AS xml FROM st)"""


def _answers(t, doc: str = "l_orderkey"):
    """Answers that repeat their statement in upper case, with another one between, under another root, or unclosed."""
    df = statements(t, doc)
    one = candidates.statement_xml(*[F.col(c) for c in COLS[:6]])
    loud, beam = F.replace(one, F.col("subject"), F.upper("subject")), F.col("beam")
    xml = (F.when(beam == 0, F.concat(F.lit("<statements>"), one, loud, F.lit("</statements>"))).when(beam == 1, F.concat(F.lit("<statements>"), one, F.lit(f"{_OTHER}\n"), loud, F.lit("</statements>")))
           .when(beam == 2, F.concat(F.lit("<answers>"), one, one, F.lit("</answers>"))).otherwise(F.concat(F.lit("<statements>"), one, loud)))
    return df.select("doc_id", "seq", "attempt", xml.alias("xml"))


@query("deduplicated_xml", f"WITH {ST}, {ANSWERS_SQL} SELECT doc_id, seq, xml FROM x")
def deduplicated_xml(t):
    """Answers without their repeated statements; those of another root or that do not parse stay as they are."""
    return candidates.deduplicated_xml(_answers(t), "xml").select("doc_id", "seq", "xml")


@query("longest_raw_xml", f"""WITH {ST_SUPP}, {ANSWERS_SQL}, n AS (SELECT *, (length(xml) - length(replace(xml, '<stmt>', ''))) // 6 AS n FROM x), s AS (SELECT doc_id, min(attempt) AS stop_at FROM n WHERE n >= 2 GROUP BY 1)
  SELECT n.doc_id, xml FROM n LEFT JOIN s ON s.doc_id = n.doc_id WHERE stop_at IS NULL OR attempt <= stop_at QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY length(xml) DESC, attempt, seq) = 1""")
def longest_raw_xml(t):
    """The longest answer of a document once repeats are out, of the attempts up to the first with two statements."""
    return candidates.longest_raw_xml(_answers(t, "l_suppkey").withColumn("expected", F.lit(2)), ["doc_id"], "xml", "attempt", "expected", ["seq"]).select("doc_id", "xml")


@query("parse_candidate_xml", f"WITH {ST} SELECT doc_id, seq, CAST(i AS INTEGER) AS stmt_idx, subject, subject_type, predicate, object, object_type, source_text FROM st, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR beam > 0")
def parse_candidate_xml(t):
    """Each answer holds the statement once or twice plus a statement without an object, which is skipped."""
    one = candidates.statement_xml(*[F.col(c) for c in COLS[:6]])
    empty = F.lit("<stmt><subject>nobody</subject><object> </object><predicate>x</predicate></stmt>")
    df = statements(t).withColumn("xml", F.concat(F.lit("<statements>"), one, F.when(F.col("beam") > 0, one).otherwise(""), empty, F.lit("</statements>")))
    return candidates.parse_statements_xml(df.select("doc_id", "seq", "xml"), "xml").select(
        "doc_id", "seq", "stmt_idx", "subject", "subject_type", "predicate", "object", "object_type", "source_text")


@query("repair_candidate_xml", f"""WITH {ST} SELECT doc_id, seq, CAST(0 AS INTEGER) AS stmt_idx, subject, subject_type, predicate,
  object || CASE beam WHEN 1 THEN ' & co' WHEN 2 THEN ' < more' ELSE '' END AS object, object_type, source_text FROM st""")
def repair_candidate_xml(t):
    """Broken answers: truncated root closer, bare ampersand, bare less-than, missing closers with a tail."""
    c = F.col
    obj = F.concat("object", F.when(c("beam") == 1, " & co").when(c("beam") == 2, " < more").otherwise(""))
    stmt = F.concat(F.lit('<stmt><subject type="ORG">'), "subject", F.lit("</subject><object"),
                    F.when(c("object_type") == "UNKNOWN", "").otherwise(F.concat(F.lit(' type="'), "object_type", F.lit('"'))), F.lit(">"), obj,
                    F.lit("</object><predicate>"), "predicate", F.lit("</predicate><text>"), "source_text", F.lit("</text>"))
    xml = F.when(c("beam") == 0, F.concat(F.lit("<statements>"), stmt, F.lit("</stmt></statemen"))).when(
        c("beam") == 3, F.concat(F.lit("<statements>"), stmt, F.lit("</statements> and so on"))).otherwise(
        F.concat(F.lit("<statements>"), stmt, F.lit("</stmt></statements>")))
    df = statements(t).select("doc_id", "seq", xml.alias("xml"))
    return candidates.parse_statements_xml(df, "xml").select(
        "doc_id", "seq", "stmt_idx", "subject", "subject_type", "predicate", "object", "object_type", "source_text")


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN 0.2 ELSE 0 END"


@query("best_relation", f"""WITH {ST_SUPP}, x AS (SELECT *, CASE WHEN beam = 0 THEN 'someone else' ELSE subject END AS head, split_part(object, ' ', 1) AS tail FROM st),
  y AS (SELECT *, round(confidence + {_overlap("'Supplier'", 'head')} + {_overlap("'red widget'", 'tail')}, 9) AS sc FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, seq) AS rn FROM y WHERE sc > 0) SELECT doc_id, seq, head, predicate AS relation, tail, round(sc, 4) AS rel_score FROM r WHERE rn = 1""")
def best_relation(t):
    df = statements(t, "l_suppkey").select(
        "doc_id", "seq", F.when(F.col("beam") == 0, "someone else").otherwise(F.col("subject")).alias("head"), F.col("predicate").alias("relation"),
        F.split_part("object", F.lit(" "), F.lit(1)).alias("tail"), F.col("confidence").alias("rel_confidence"), F.lit("Supplier").alias("subject"),
        F.lit("red widget").alias("object"))
    return candidates.best_relation(df, ["doc_id"], ["seq"]).select("doc_id", "seq", "head", "relation", "tail", F.round("rel_score", 4).alias("rel_score"))


@query("refined_candidates", f"""WITH {ST}, x AS (SELECT *, split_part(object, ' ', 1) AS mo, CASE WHEN beam = 3 THEN NULL ELSE source_text END AS src, CASE WHEN beam = 2 THEN '' ELSE predicate END AS mp FROM st)
  SELECT doc_id, seq, CAST(0 AS INTEGER) AS cand_idx, subject, mp AS predicate, mo AS object, CASE WHEN src IS NULL THEN 'model' ELSE 'hybrid' END AS extraction_method FROM x WHERE mp <> ''
  UNION ALL SELECT doc_id, seq, CAST(1 AS INTEGER), subject, mp, object, 'gliner' FROM x WHERE mp <> '' AND src IS NOT NULL AND object <> mo""")
def refined_candidates(t):
    """Model objects are the first word of the part name; the entity list holds the full name."""
    df = statements(t).select(
        "doc_id", "seq", "subject", F.split_part("object", F.lit(" "), F.lit(1)).alias("object"), F.col("object").alias("full"),
        F.when(F.col("beam") == 2, "").otherwise(F.col("predicate")).alias("predicate"), F.when(F.col("beam") != 3, F.col("source_text")).alias("source_text"))
    ents = F.array(F.lit("x"), F.col("full"), F.col("subject"))
    df = df.withColumns({"r_subject": candidates.refine_boundary(F.col("subject"), ents), "r_object": candidates.refine_boundary(F.col("object"), ents),
                         "r_predicate": F.col("predicate")}).drop("full")
    return candidates.refined_candidates(df).select("doc_id", "seq", "cand_idx", "subject", "predicate", "object", "extraction_method")


# ---- scores ----------------------------------------------------------------------------------

_TIER = "CASE WHEN {0} >= 0.9 THEN 1.0 WHEN {0} >= 0.7 THEN 0.8 WHEN {0} >= 0.5 THEN 0.6 WHEN {0} > 0 THEN 0.4 ELSE 0.2 END"


@query("triple_scores", f"""WITH {ST}, d AS (SELECT DISTINCT subject, predicate, object, source_text, confidence FROM st),
  {similarity_sql("SELECT source_text AS a, subject || ' ' || predicate || ' ' || object AS b FROM d")},
  e AS (SELECT d.*, s, confidence AS se, 0.99 * 0.8 AS oe FROM d JOIN sim ON a = source_text AND b = subject || ' ' || predicate || ' ' || object)
  SELECT subject, predicate, object, source_text, confidence, CAST({_TIER.format('se')} AS DOUBLE) AS subject_score, CAST({_TIER.format('oe')} AS DOUBLE) AS object_score,
    round(0.5 * s + 0.25 * {_TIER.format('se')} + 0.25 * {_TIER.format('oe')}, 4) AS score FROM e""")
def triple_scores(t):
    c = F.col
    d = statements(t).select("subject", "predicate", "object", "source_text", "confidence").distinct()
    ments = F.array(F.struct(c("subject").alias("text"), c("confidence").alias("confidence")),
                    F.struct(F.split_part("object", F.lit(" "), F.lit(1)).alias("text"), F.lit(0.99).alias("confidence")))
    d = d.withColumns({"subject_score": scoring.entity_score(c("subject"), ments), "object_score": scoring.entity_score(c("object"), ments)})
    return d.withColumn("score", F.round(scoring.triple_score(c("subject"), c("predicate"), c("object"), c("source_text"), c("subject_score"), c("object_score")), 4))


_SUBJ, _OBJ = "regexp_extract(sentence, '([a-zA-Z]{4,})', 1)", "regexp_extract(sentence, '^.*[^a-zA-Z]([a-zA-Z]{4,})', 1)"
SPANS_SQL = f"""{SENTENCES_SQL}, a0 AS (SELECT doc_id, sent_idx, text, sentence, {_SUBJ} AS subject, {_OBJ} AS object FROM sents),
  a1 AS (SELECT *, CASE WHEN sent_idx % 2 = 0 THEN sentence END AS src, strpos(lower(text), lower(subject)) - 1 AS s_at, strpos(lower(text), lower(object)) - 1 AS o_at FROM a0 WHERE subject <> '' AND object <> ''),
  a2 AS (SELECT *, strpos(lower(text), lower(src)) - 1 AS src_at, least(s_at, o_at) AS lo, greatest(s_at + length(subject), o_at + length(object)) AS hi FROM a1),
  spans AS (SELECT doc_id, sent_idx, CAST(CASE WHEN src_at >= 0 THEN src_at WHEN s_at >= 0 AND o_at >= 0 THEN lo - length(regexp_extract(substr(text, 1, lo), '([^.!?\\n]*)\\z', 1)) END AS INTEGER) AS span_start,
    CAST(CASE WHEN src_at >= 0 THEN src_at + length(src) WHEN s_at >= 0 AND o_at >= 0 THEN hi + length(regexp_extract(substr(text, hi + 1), '^([^.!?\\n]*[.!?\\n]?)', 1)) END AS INTEGER) AS span_end FROM a2)"""


def _spans(t):
    """Statements of sentences (every second one gives its sentence as source text) and their evidence in the document."""
    s = candidates.split_sentences(t.documents.select("doc_id", "text")).drop("text")
    subj, obj = F.regexp_extract("sentence", "([a-zA-Z]{4,})", 1), F.regexp_extract("sentence", "^.*[^a-zA-Z]([a-zA-Z]{4,})", 1)
    st = s.select("doc_id", "sent_idx", subj.alias("subject"), obj.alias("object"), F.when(F.col("sent_idx") % 2 == 0, F.col("sentence")).alias("source_text"))
    st = st.where((F.col("subject") != "") & (F.col("object") != ""))
    return evidence.evidence_spans(t.documents, st, "doc_id", "text", ["sent_idx"])


@query("evidence_spans", f"WITH {SPANS_SQL} SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, span_start, span_end FROM spans")
def evidence_spans(t):
    return _spans(t).select("doc_id", "sent_idx", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("coverage", f"""WITH {SPANS_SQL}, chars AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)),
  content AS (SELECT doc_id, pos FROM chars WHERE NOT regexp_matches(ch, '{WS}')), tot AS (SELECT doc_id, count(*) AS n FROM content GROUP BY 1),
  cov AS (SELECT DISTINCT doc_id, sent_idx % 4 AS beam, unnest(range(span_start, span_end)) AS pos FROM spans),
  hit AS (SELECT doc_id, beam, count(*) AS h FROM cov JOIN content USING (doc_id, pos) GROUP BY ALL)
  SELECT b.doc_id, CAST(b.beam AS INTEGER) AS beam, round(coalesce(h, 0) / tot.n, 4) AS coverage FROM (SELECT DISTINCT doc_id, sent_idx % 4 AS beam FROM spans) b LEFT JOIN hit USING (doc_id, beam) JOIN tot USING (doc_id)""")
def coverage(t):
    spans = _spans(t).withColumn("beam", (F.col("sent_idx") % 4).cast("int"))
    return evidence.coverage(spans, t.documents, "doc_id", ["beam"], "text").select("doc_id", "beam", F.round("coverage", 4).alias("coverage"))


# ---- predicates ------------------------------------------------------------------------------

_CANON = ", ".join(f"({i}, '{p}')" for i, p in enumerate(fixed.CANONICAL_PREDICATES))


@query("predicate_match", f"""WITH w AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS t FROM documents)),
  cp(id, t) AS (VALUES {_CANON}), {gram_sql("w", "w")}, {gram_sql("k", "cp")},
  d AS (SELECT w_g.id AS w, k_g.id AS k, sum(w_g.n * k_g.n) AS dot FROM w_g JOIN k_g USING (bucket) GROUP BY 1, 2),
  s AS (SELECT w, k, round(dot / (w_n.len * k_n.len), 9) AS s FROM d JOIN w_n ON w_n.id = w JOIN k_n ON k_n.id = k),
  r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, k) AS rn FROM s)
  SELECT w.t AS original, CASE WHEN r.s >= 0.5 THEN cp.t END AS canonical, round(coalesce(r.s, 0), 4) AS similarity, coalesce(r.s, 0) >= 0.5 AS matched
  FROM w LEFT JOIN r ON r.w = w.id AND rn = 1 LEFT JOIN cp ON cp.id = r.k""")
def predicate_match(t):
    """Every distinct word of the documents as a predicate, embedded once, against the canonical list."""
    w = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("original")).distinct()
    m = w.withColumn("m", best_of(fixed.CANONICAL_PREDICATES)(tx.lower_strip(F.col("original"))))
    ok = F.col("m.similarity") >= 0.5
    return m.select("original", F.when(ok, F.col("m.candidate")).alias("canonical"), F.round("m.similarity", 4).alias("similarity"), ok.alias("matched"))


@query("predicate_similarity", f"""WITH x AS (SELECT DISTINCT lower(p_name) AS a, lower(p_name || ' ' || p_type) AS b FROM part), {similarity_sql("SELECT a, b FROM x")}
  SELECT a AS left_text, b AS right_text, round(s, 4) AS similarity, s >= 0.65 AS similar FROM sim""")
def predicate_similarity(t):
    x = t.part.select(F.lower("p_name").alias("left_text"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("right_text")).distinct()
    s = x.withColumn("s", text_cosine(F.col("left_text"), F.col("right_text")))
    return s.select("left_text", "right_text", F.round("s", 4).alias("similarity"), (F.col("s") >= 0.65).alias("similar"))


_PLACE = "CASE s_suppkey % 4 WHEN 0 THEN ' is located in ' WHEN 1 THEN ' operates in ' WHEN 2 THEN ' was fined by ' ELSE ' is a supplier of ' END"


@query("canonical_predicate_in_context", f"""WITH x AS (SELECT s_suppkey, s_name, n_name, s_name || {_PLACE} || n_name AS src FROM supplier JOIN nation ON s_nationkey = n_nationkey), cp(i, c) AS (VALUES {_CANON}),
  {similarity_sql("SELECT lower(src) AS a, lower(s_name || ' ' || c || ' ' || n_name) AS b FROM x, cp")},
  r AS (SELECT s_suppkey, c, round(s, 9) AS s, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(s, 9) DESC, i) AS rn FROM x, cp JOIN sim ON a = lower(src) AND b = lower(s_name || ' ' || c || ' ' || n_name))
  SELECT s_suppkey, CASE WHEN s >= 0.5 THEN c END AS canonical_predicate, round(s, 4) AS similarity FROM r WHERE rn = 1""")
def canonical_predicate_in_context(t):
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("src", F.concat(F.col("s_name"), F.expr(_PLACE), F.col("n_name")))
    m = x.withColumn("m", best_in_context(fixed.CANONICAL_PREDICATES)(F.col("s_name"), F.col("n_name"), F.lower("src")))
    return m.select("s_suppkey", F.when(F.col("m.similarity") >= 0.5, F.col("m.candidate")).alias("canonical_predicate"), F.round("m.similarity", 4).alias("similarity"))


@query("reversal_fix", f"""WITH x AS (SELECT c_custkey, c_custkey % 2 = 1 AS swapped, c_name, n_name, c_name || ' lives in ' || n_name AS src FROM customer JOIN nation ON c_nationkey = n_nationkey),
  y AS (SELECT *, CASE WHEN swapped THEN n_name ELSE c_name END AS subject, CASE WHEN swapped THEN c_name ELSE n_name END AS object FROM x),
  {similarity_sql("SELECT lower(subject || ' lives in ' || object) AS a, lower(src) AS b FROM y UNION ALL SELECT lower(object || ' lives in ' || subject), lower(src) FROM y")},
  z AS (SELECT y.*, round(n.s, 9) AS ns, round(r.s, 9) AS rs FROM y JOIN sim n ON n.a = lower(subject || ' lives in ' || object) AND n.b = lower(src) JOIN sim r ON r.a = lower(object || ' lives in ' || subject) AND r.b = lower(src))
  SELECT c_custkey, CASE WHEN rs > ns + 0.05 THEN object ELSE subject END AS subject, CASE WHEN rs > ns + 0.05 THEN subject ELSE object END AS object, rs > ns + 0.05 AS was_reversed, rs > ns AS should_reverse FROM z""")
def reversal_fix(t):
    c = F.col
    x = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey"))
    swapped = c("c_custkey") % 2 == 1
    df = x.select("c_custkey", F.when(swapped, c("n_name")).otherwise(c("c_name")).alias("subject"), F.lit("lives in").alias("predicate"),
                  F.when(swapped, c("c_name")).otherwise(c("n_name")).alias("object"), F.lit("PERSON").alias("subject_type"), F.lit("GPE").alias("object_type"),
                  F.concat(c("c_name"), F.lit(" lives in "), c("n_name")).alias("source_text"))
    return dedup.fix_reversals(df).select("c_custkey", "subject", "object", "was_reversed", (c("sim_reversed") > c("sim_normal")).alias("should_reverse"))


@query("reversed_statements", f"WITH {ST} SELECT doc_id, seq, object AS subject, object_type AS subject_type, predicate, subject AS object, subject_type AS object_type, true AS was_reversed FROM st")
def reversed_statements(t):
    return dedup.reverse_statements(statements(t)).select("doc_id", "seq", "subject", "subject_type", "predicate", "object", "object_type", "was_reversed")


@query("merged_types", f"WITH {ST}, k AS (SELECT object, max(CASE WHEN object_type <> 'UNKNOWN' THEN object_type END) AS other FROM st GROUP BY 1) SELECT doc_id, seq, st.object, CASE WHEN object_type = 'UNKNOWN' THEN coalesce(other, 'UNKNOWN') ELSE object_type END AS object_type FROM st JOIN k ON k.object = st.object")
def merged_types(t):
    """Unknown object types filled from another statement about the same object."""
    df = statements(t)
    known = df.groupBy("object").agg(F.max(F.when(F.col("object_type") != "UNKNOWN", F.col("object_type"))).alias("other"))
    out = df.join(known, "object")
    return out.select("doc_id", "seq", "object", dedup.merge_types(F.col("object_type"), F.coalesce("other", F.lit("UNKNOWN"))).alias("object_type"))


def _dedup_sql() -> str:
    """The fold as a recursive CTE: step n meets the n-th statement of every (document, pair) block with the block's
    survivors so far; `alike` are the predicates near enough to its own."""
    names = ["pos", "seq", "subject", "subject_type", "predicate", "object", "object_type", "source_text", "confidence", "sn", "sr", "rev"]
    pack = lambda **v: "struct_pack(" + ", ".join(f"{n} := {v[n]}" for n in names) + ")"
    of = lambda s, **other: pack(**{n: f"{s}.{n}" for n in names} | other)
    turned = lambda s: of(s, subject=f"{s}.object", object=f"{s}.subject", subject_type=f"{s}.object_type", object_type=f"{s}.subject_type", rev="true")
    typed = lambda s, o, **other: of(s, **{c: f"CASE WHEN {s}.{c} = 'UNKNOWN' THEN {o}.{c} ELSE {s}.{c} END" for c in ("subject_type", "object_type")}, **other)
    low = lambda c: f"trim(lower({c}))"
    flip = "substr(seq, 2, 1) IN ('2', '5')"
    pick = lambda a, b: f"CASE WHEN {flip} THEN {b} ELSE {a} END"
    spo, ops = low("subject || ' ' || predicate || ' ' || object"), low("object || ' ' || predicate || ' ' || subject")
    return f"""WITH RECURSIVE {ST_SUPP}, f AS MATERIALIZED (SELECT doc_id, seq, {pick('subject', 'object')} AS subject, {pick('subject_type', 'object_type')} AS subject_type, predicate,
    {pick('object', 'subject')} AS object, {pick('object_type', 'subject_type')} AS object_type, source_text, confidence FROM st),
  {similarity_sql(f"SELECT {spo} AS a, {low('source_text')} AS b FROM f UNION SELECT {ops}, {low('source_text')} FROM f", "wsim")},
  {similarity_sql(f"SELECT DISTINCT {low('x.predicate')} AS a, {low('y.predicate')} AS b FROM (SELECT DISTINCT predicate FROM f) x, (SELECT DISTINCT predicate FROM f) y", "psim")},
  near AS (SELECT a, list(b) AS alike FROM psim WHERE round(s, 9) >= 0.65 GROUP BY 1),
  x AS MATERIALIZED (SELECT doc_id, least({low('subject')}, {low('object')}) || chr(1) || greatest({low('subject')}, {low('object')}) AS blk, coalesce(alike, []) AS alike,
    row_number() OVER (PARTITION BY doc_id, least({low('subject')}, {low('object')}) || chr(1) || greatest({low('subject')}, {low('object')}) ORDER BY seq) AS n,
    {pack(pos="seq", seq="seq", subject="subject", subject_type="subject_type", predicate="predicate", object="object", object_type="object_type", source_text="source_text",
          confidence="confidence", sn="round(w1.s, 9)", sr="round(w2.s, 9)", rev="false")} AS s
    FROM f JOIN wsim w1 ON w1.a = {spo} AND w1.b = {low('source_text')} JOIN wsim w2 ON w2.a = {ops} AND w2.b = {low('source_text')} LEFT JOIN near ON near.a = {low('predicate')}),
  g AS (SELECT doc_id, blk, CAST(1 AS BIGINT) AS n, [s] AS surv FROM x WHERE n = 1
    UNION ALL SELECT doc_id, blk, n, CASE WHEN j = 0 THEN list_append(surv, s) ELSE list_concat(list_append(surv[1:j - 1], u), surv[j + 1:]) END FROM (
      SELECT *, CASE WHEN same AND s.sn > h.sn THEN {typed('s', 'h', pos='h.pos')} WHEN same THEN {typed('h', 's')}
        WHEN better THEN {typed('s2', 'h2', pos='h.pos')} ELSE {typed('h2', 's2')} END AS u FROM (
        SELECT *, CASE WHEN s.sr > s.sn THEN {turned('s')} ELSE s END AS s2, CASE WHEN h.sr > h.sn AND (better OR NOT h.rev) THEN {turned('h')} ELSE h END AS h2 FROM (
          SELECT *, {low('s.subject')} = {low('h.subject')} AS same, greatest(s.sn, s.sr) > greatest(h.sn, h.sr) AS better FROM (
            SELECT *, surv[j] AS h FROM (SELECT g.doc_id, g.blk, x.n, surv, s, coalesce(list_position(list_transform(surv, lambda v: list_contains(alike, {low('v.predicate')})), true), 0) AS j
              FROM g JOIN x ON x.doc_id = g.doc_id AND x.blk = g.blk AND x.n = g.n + 1))))) ),
  e AS (SELECT doc_id, unnest(surv) AS v FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, blk ORDER BY n DESC) = 1)
  SELECT doc_id, v.pos AS position, v.seq AS seq, {", ".join(f"v.{c} AS {c}" for c in COLS)}, v.rev AS was_reversed FROM e"""


@query("semantic_dedup", _dedup_sql())
def semantic_dedup(t):
    """Order-dependent greedy de-duplication with reversals."""
    df = statements(t, "l_suppkey")
    flip = F.substring("seq", 2, 1).isin("2", "5")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    df = df.withColumns({"subject": pick("subject", "object"), "object": pick("object", "subject"),
                         "subject_type": pick("subject_type", "object_type"), "object_type": pick("object_type", "subject_type")})
    out = dedup.semantic_dedup(df.select("doc_id", "seq", *COLS), ["doc_id"], "seq")
    return out.select("doc_id", "position", "seq", *COLS, "was_reversed")


# ---- relations -------------------------------------------------------------------------------

LEXICON = [("is", "instance_of", "attribute", 0.8), ("was", "was", "attribute", 0.7), ("with", "works_with", "people", 0.9),
           ("for", "made_for", "supply", 0.78), ("from", "comes_from", "place", 0.85), ("por", "made_by", "supply", 0.76),
           ("par", "made_by", "supply", 0.76), ("mit", "works_with", "people", 0.74)]
_LEX = ", ".join(f"('{a}', '{b}', '{c}', CAST({d} AS DOUBLE))" for a, b, c, d in LEXICON)


@query("lexicon_relations", f"""WITH {SENTENCES_SQL}, lx(trigger, predicate, predicate_category, confidence) AS (VALUES {_LEX}),
  k AS (SELECT doc_id, sent_idx, string_split(sentence, ' ') AS w FROM sents), p AS (SELECT doc_id, sent_idx, w, unnest(range(1, len(w) - 1)) AS i FROM k WHERE len(w) >= 3),
  h AS (SELECT doc_id, sent_idx, i, regexp_extract(w[i], '[\\pL\\pN_]+\\z') AS head, w[i + 1] AS trg, regexp_extract(w[i + 2], '^[\\pL\\pN_]+') AS tail FROM p)
  SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, CAST(row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY i) - 1 AS INTEGER) AS rel_idx, head, predicate, predicate_category, tail, confidence
  FROM h JOIN lx ON trg = trigger WHERE head <> '' AND tail <> ''""")
def lexicon_relations(t):
    s = candidates.split_sentences(t.documents.select("doc_id", "text")).drop("text")
    return relations.lexicon_relations(s, LEXICON).select("doc_id", "sent_idx", "rel_idx", "head", "predicate", "predicate_category", "tail", "confidence")


@query("accepted_relations", f"WITH {ST_SUPP}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, seq) AS INTEGER) AS rank FROM st WHERE confidence >= 0.75) SELECT doc_id, rank, seq, confidence FROM r")
def accepted_relations(t):
    return relations.accepted_relations(statements(t, "l_suppkey"), ["doc_id"], [F.asc("seq")]).select("doc_id", "rank", "seq", "confidence")


@query("relation_shapes", f"""WITH {ST}, x AS (SELECT *, CAST(substr(seq, 1, 2) AS INTEGER) % 7 AS shape FROM st)
  SELECT doc_id, seq, subject AS head, object AS tail, round(CASE shape WHEN 0 THEN 0.5 WHEN 1 THEN confidence WHEN 2 THEN least(confidence, 0.6) WHEN 3 THEN confidence WHEN 4 THEN least(confidence, 0.7) WHEN 5 THEN confidence ELSE 0.5 END, 4) AS confidence FROM x""")
def relation_shapes(t):
    c = F.col
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    s, o, conf = q(c("subject")), q(c("object")), c("confidence").cast("string")
    shape = F.substring("seq", 1, 2).cast("int") % 7
    j = (F.when(shape == 0, cat("[", s, ", ", o, "]")).when(shape == 1, cat("[", s, ', {"text": ', o, "}, ", conf, "]"))
         .when(shape == 2, cat('[{"text": ', s, ', "score": ', conf, '}, {"text": ', o, ', "confidence": 0.6}]'))
         .when(shape == 3, cat('{"head": {"text": ', s, '}, "tail": ', o, ', "score": ', conf, "}"))
         .when(shape == 4, cat('{"source": {"name": ', s, ', "prob": ', conf, '}, "target": {"span": ', o, ', "score": 0.7}}'))
         .when(shape == 5, cat('{"subject": {"text": ', s, ', "score": 0, "confidence": ', conf, '}, "object": {"text": ', o, '}, "score": 0}'))
         .otherwise(cat('{"head": ', s, ', "tail": ', o, "}")))
    r = statements(t).withColumn("r", relations.parse_relation(j))
    return r.select("doc_id", "seq", "r.head", "r.tail", F.round("r.confidence", 4).alias("confidence"))


@query("inferred_types", f"""WITH {ST} SELECT doc_id, seq, 'PRODUCT' AS object_kind, CASE WHEN beam = 0 THEN 'UNKNOWN' ELSE 'ORG' END AS subject_kind FROM st""")
def inferred_types(t):
    c = F.col
    ents = F.array(F.struct(F.lit("product").alias("kind"), F.upper(F.split_part("object", F.lit(" "), F.lit(2))).alias("text")),
                   F.struct(F.when(c("beam") == 0, "Animal").otherwise("Company").alias("kind"), c("subject").alias("text")))
    return statements(t).select("doc_id", "seq", relations.infer_entity_type(c("object"), ents).alias("object_kind"),
                                relations.infer_entity_type(c("subject"), ents).alias("subject_kind"))


@query("predicate_categories", f"""WITH {ST}, c(category, p) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b, _ in fixed.PREDICATE_TABLE)}),
  x AS (SELECT doc_id, seq, CASE WHEN beam = 0 THEN upper(predicate) ELSE predicate END AS predicate FROM st) SELECT doc_id, seq, predicate, coalesce(c1.category, c2.category) AS category
  FROM x LEFT JOIN c c1 ON c1.p = predicate LEFT JOIN c c2 ON c2.p = replace(replace(lower(predicate), ' ', '_'), '-', '_')""")
def predicate_categories(t):
    p = F.when(F.col("beam") == 0, F.upper("predicate")).otherwise(F.col("predicate"))
    return statements(t).withColumn("predicate", p).select("doc_id", "seq", "predicate", relations.predicate_category(F.col("predicate")).alias("category"))


@query("classified_texts", f"WITH {ST} SELECT doc_id, seq, source_text, CASE WHEN contains(source_text, 'ship') THEN 'movement' ELSE 'trade' END AS label, CAST(CASE WHEN contains(source_text, 'ship') THEN 0.95 ELSE 0.85 END AS DOUBLE) AS label_confidence FROM st")
def classified_texts(t):
    """A text classifier run once per distinct source text; the default confidence fills its gaps."""
    ship = lambda c: c.contains("ship")
    rule = lambda c: F.struct(F.when(ship(c), "movement").otherwise("trade").alias("label"), F.when(ship(c), F.lit(0.95)).alias("confidence"))
    return relations.classify_distinct(statements(t), "source_text", rule).select("doc_id", "seq", "source_text", "label", "label_confidence")


@query("latest_classification", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  SELECT 'u' || user_id AS source_text, event_type AS label_type, ts, event_id, round(value, 4) AS value FROM r WHERE rn = 1""")
def latest_classification(t):
    log = t.events.select(F.concat(F.lit("u"), "user_id").alias("source_text"), F.col("event_type").alias("label_type"), "ts", "event_id", F.round("value", 4).alias("value"))
    return relations.latest_classification(log, "ts")


@query("statements_of_candidates")
def statements_of_candidates(t):
    """The whole single-call extraction over derived answers: one document per supplier, one answer per lineitem."""
    from .candidates_flow import ExtractionOptions, statements_from_candidates
    st = _with_xml(statements(t, "l_suppkey"))
    answers = st.select("doc_id", "attempt", F.substring("seq", 3, 24).alias("line"), "xml")
    answers = answers.withColumn("beam", F.pmod(F.xxhash64("line"), F.lit(8)).cast("int")).drop("line")
    # several one-statement answers share a beam number; the document text is the supplier's own sentence
    docs = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.concat("s_name", F.lit(" supplies red widget. It also ships blue bolt and takes back old gear.")).alias("text"))
    opt = ExtractionOptions(predicates=("supplier", "distributor", "contractor"))
    out = statements_from_candidates(answers, docs, opt)
    return out.select("doc_id", "subject", "predicate", "object", "source_text", F.round("confidence", 4).alias("confidence"), "canonical_predicate", "was_reversed")
