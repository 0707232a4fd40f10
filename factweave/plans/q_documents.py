"""Catalogue: pages, chunks, provenance, end-to-end documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates, chunking, documents, ranges
from ..sources import documents as src
from .derived import PAGES_SQL, SENTENCES_SQL, sql_norm, statements, statements_sql
from .flow import FlowConfig, document_statements, text_statements
from .registry import query


def _pages(t):
    return ranges.page_offsets(src.page_rows(t.conversations))


@query("page_at_char", f"""WITH {PAGES_SQL}, s AS (SELECT *, char_offset + length(text) AS char_end FROM pg), pt AS (SELECT doc_id, page_number AS origin, unnest([char_offset, char_offset + length(text) // 2, char_end, char_end + 7]) AS char_pos, generate_subscripts([1,2,3,4], 1) AS i FROM s),
  l AS (SELECT doc_id, max(page_number) AS lp, max_by(char_end, page_number) AS le FROM s GROUP BY 1)
  SELECT pt.doc_id, origin, char_pos, coalesce(s.page_number, CASE WHEN char_pos >= le THEN lp END) AS page_number FROM pt LEFT JOIN s ON s.doc_id = pt.doc_id AND char_pos >= char_offset AND char_pos < char_end JOIN l ON l.doc_id = pt.doc_id""")
def page_at_char(t):
    p = _pages(t)
    at = F.array("char_offset", F.col("char_offset") + F.floor(F.length("text") / 2), F.col("char_end"), F.col("char_end") + 7)
    pts = p.select("doc_id", F.col("page_number").alias("origin"), F.explode(at).alias("char_pos"))
    return ranges.page_at_char(pts, p.select("doc_id", "page_number", "char_offset", "char_end")).select("doc_id", "origin", "char_pos", "page_number")


@query("pages_in_range", f"""WITH {PAGES_SQL}, s AS (SELECT *, char_offset + length(text) AS char_end FROM pg), r AS (SELECT doc_id, page_number AS origin, char_offset + length(text) // 2 AS start_char, char_end + 300 AS end_char FROM s)
  SELECT r.doc_id, origin, start_char, end_char, s.page_number FROM r JOIN s ON s.doc_id = r.doc_id AND s.char_offset < r.end_char AND s.char_end > r.start_char""")
def pages_in_range(t):
    p = _pages(t)
    r = p.select("doc_id", F.col("page_number").alias("origin"), (F.col("char_offset") + F.floor(F.length("text") / 2)).alias("start_char"), (F.col("char_end") + 300).alias("end_char"))
    return ranges.pages_in_range(r, p.select("doc_id", "page_number", "char_offset", "char_end")).select("doc_id", "origin", "start_char", "end_char", "page_number")


SMALL = chunking.ChunkConfig(target_tokens=100, max_tokens=200, overlap_tokens=20)


@query("chunk_documents")
def chunk_documents(t):
    """Chunks of whole document texts; the sequential boundary rule is tested against a reference fold."""
    return chunking.chunk_texts(t.documents, "doc_id", "text", SMALL).drop("page_numbers")


@query("chunk_pages")
def chunk_pages(t):
    c = chunking.chunk_pages(_pages(t), "doc_id", SMALL)
    return c.select("doc_id", "chunk_index", "start_char", "end_char", "token_count", "overlap_chars", F.array_join("page_numbers", ",").alias("pages"),
                    chunking.primary_page(F.col("page_numbers")).alias("primary_page"), tx.preview(F.col("text")).alias("preview"))


@query("chunk_sentences")
def chunk_sentences(t):
    """Sentences of page chunks with chunk and primary page carried along, repeated ones across chunks removed."""
    c = chunking.chunk_pages(_pages(t), "doc_id", SMALL).withColumn("page_number", chunking.primary_page(F.col("page_numbers")))
    s = candidates.split_sentences(c.select("doc_id", "chunk_index", "page_number", "text")).drop("text")
    return documents.cross_chunk_dedup(s, "doc_id", "sentence", [F.asc("chunk_index"), F.asc("sent_idx")])


@query("sentences_by_page", f"""WITH x AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, unnest(list_filter(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda v: length(trim(regexp_replace(v, '\\s+', ' ', 'g'))) > 0)) AS s FROM conversations)
  SELECT doc_id, page_number, count(*) AS sentences, count(DISTINCT {sql_norm('s')}) AS distinct_sentences FROM x GROUP BY 1, 2""")
def sentences_by_page(t):
    s = candidates.split_sentences(src.page_rows(t.conversations))
    per = s.groupBy("doc_id", "page_number", tx.norm_key(F.col("sentence")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id", "page_number").agg(F.sum("n").alias("sentences"), F.count(F.lit(1)).alias("distinct_sentences"))


@query("sentence_provenance", f"""WITH {SENTENCES_SQL}, d AS (SELECT DISTINCT doc_id, sentence AS source FROM sents)
  SELECT d.doc_id, source, CAST(min(sent_idx) AS INTEGER) AS sent_idx, arg_min(sentence, sent_idx) AS sentence FROM d JOIN sents s ON s.doc_id = d.doc_id AND contains(source, sentence) GROUP BY 1, 2""")
def sentence_provenance(t):
    """First sentence of a document contained in each statement's source text."""
    s = candidates.split_sentences(t.documents.select("doc_id", "text")).drop("text")
    st = s.select("doc_id", F.col("sentence").alias("source"))
    return documents.provenance(st, s, "doc_id", "source", "sentence", "sent_idx")


@query("stage_timings", "SELECT user_id AS run, event_type AS stage, round(sum(value), 2) AS seconds, count(*) AS runs FROM events GROUP BY 1, 2")
def stage_timings(t):
    e = t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "value")
    out = documents.stage_timings(e, ["run"], "stage", "value")
    return out.withColumn("seconds", F.round("seconds", 2))


@query("page_full_texts", "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1")
def page_full_texts(t):
    """Whole documents with a blank line between pages."""
    return documents.join_pages(src.page_rows(t.conversations), sep="\n\n")


@query("page_document_texts", "SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS full_text, length(string_agg(text, chr(10) ORDER BY turn)) AS chars FROM conversations GROUP BY 1")
def page_document_texts(t):
    return documents.join_pages(src.page_rows(t.conversations)).withColumn("chars", F.length("full_text").cast("long"))


@query("statements_by_page_and_chunk", f"""WITH {statements_sql()}, x AS (SELECT doc_id, attempt AS chunk_index, CASE WHEN beam > 0 THEN beam END AS page_number FROM st)
  SELECT doc_id, 'page' AS part, CAST(page_number AS INTEGER) AS number, count(*) AS statements FROM x WHERE page_number IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, 'chunk', CAST(chunk_index AS INTEGER), count(*) FROM x GROUP BY ALL""")
def statements_by_page_and_chunk(t):
    """Statements of each page and of each chunk; statements without a page are in none."""
    s = statements(t).select("doc_id", F.col("attempt").alias("chunk_index"), F.when(F.col("beam") > 0, F.col("beam")).alias("page_number"))
    each = lambda part, name: documents.statements_by(s, "doc_id", name).select("doc_id", F.lit(part).alias("part"), F.col(name).cast("int").alias("number"), "statements")
    return each("page", "page_number").unionByName(each("chunk", "chunk_index"))


LOGS_SQL = """lg AS (SELECT user_id AS doc_id, event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS stage, CAST(trunc(value) AS BIGINT) AS s, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' END AS level,
    CASE WHEN event_type IN ('error', 'view') THEN event_type || ' ' || event_id END AS message FROM events),
  tm AS (SELECT doc_id, stage, sum(s)::BIGINT AS s FROM lg WHERE stage IS NOT NULL GROUP BY 1, 2), tt AS (SELECT doc_id, list(stage ORDER BY stage) AS stages, list(s ORDER BY stage) AS seconds FROM tm GROUP BY 1),
  ms AS (SELECT doc_id, coalesce(list(message ORDER BY event_id) FILTER (level = 'error'), []) AS errors, coalesce(list(message ORDER BY event_id) FILTER (level = 'warning'), []) AS warnings FROM lg WHERE message IS NOT NULL GROUP BY 1)"""


def _logs(t):
    kind = F.col("event_type")
    e = t.events.select(F.col("user_id").alias("doc_id"), "event_id", F.when(F.col("event_id") % 11 != 0, kind).alias("stage"), F.col("value").cast("long").alias("s"),
                        F.when(kind == "error", "error").when(kind == "view", "warning").alias("level"), F.when(kind.isin("error", "view"), F.concat_ws(" ", kind, "event_id")).alias("message"))
    return documents.merged_logs(e, "doc_id", "stage", "s", "level", "message", ["event_id"])


@query("merged_logs", f"""WITH {LOGS_SQL} SELECT coalesce(tt.doc_id, ms.doc_id) AS doc_id, array_to_string(stages, ',') AS stages, array_to_string(seconds, ',') AS seconds, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings
  FROM tt FULL JOIN ms ON tt.doc_id = ms.doc_id""")
def merged_logs(t):
    """Stage times added up and messages in order over the chunks of a document."""
    text = lambda c, n: F.array_join(c.cast("array<string>"), ",").alias(n)
    return _logs(t).select("doc_id", text(F.map_keys("timings"), "stages"), text(F.map_values("timings"), "seconds"), text(F.col("errors"), "errors"), text(F.col("warnings"), "warnings"))


@query("context_dicts", f"""WITH {statements_sql()}, {LOGS_SQL},
  pd AS (SELECT doc_id, count(DISTINCT attempt) AS chunks, count(*) AS n, list({{'subject': subject, 'predicate': predicate, 'object': object, 'source_text': source_text}} ORDER BY seq) AS stmts FROM st GROUP BY 1)
  SELECT o_orderkey AS doc_id, CAST(to_json({{'document_id': o_orderkey, 'document_title': o_orderpriority, 'summary': CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'chunk_count': coalesce(chunks, 0), 'statement_count': coalesce(n, 0),
    'duplicates_removed': o_custkey, 'statements': coalesce(stmts, []), 'timings': coalesce(map(stages, seconds), map([]::VARCHAR[], []::BIGINT[])), 'errors': coalesce(errors, []), 'warnings': coalesce(warnings, [])}}) AS VARCHAR) AS context
  FROM orders LEFT JOIN pd ON pd.doc_id = o_orderkey LEFT JOIN tt ON tt.doc_id = o_orderkey LEFT JOIN ms ON ms.doc_id = o_orderkey""")
def context_dicts(t):
    """The dictionary form of every document's context, with or without statements and logs."""
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("summary"), F.col("o_custkey").alias("duplicates_removed"))
    return documents.context_dict(docs, statements(t), _logs(t), "doc_id", "attempt", ["seq"], ["subject", "predicate", "object", "source_text"])


@query("statements_of_texts")
def statements_of_texts(t):
    """Whole texts to labeled statements: split, relate, link, label, topics."""
    return text_statements(t.documents.select("doc_id", "text"), t.supplier, FlowConfig())


@query("statements_of_documents")
def statements_of_documents(t):
    """Multi-page documents to cited statements: pages, chunks, sentences, cross-chunk dedup, the same stages."""
    return document_statements(_pages(t), t.supplier, FlowConfig(chunking=SMALL))
