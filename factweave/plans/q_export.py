"""Catalogue: graph tables, export rows and reading exports back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates, export
from .derived import statements, statements_sql
from .registry import query

ST = statements_sql()
NODE_SQL = "nd AS (SELECT DISTINCT subject AS name, subject_type AS type FROM st UNION SELECT object, object_type FROM st)"


@query("graph_nodes", f"WITH {ST}, {NODE_SQL} SELECT type || ':' || name AS id, name, type FROM nd")
def graph_nodes(t):
    return export.graph_nodes(statements(t))


@query("graph_edges", f"WITH {ST} SELECT subject_type || ':' || subject AS source, object_type || ':' || object AS target, predicate FROM st")
def graph_edges(t):
    return export.graph_edges(statements(t))


@query("graph_edges_of_products", f"WITH {ST} SELECT subject_type || ':' || subject AS source, object_type || ':' || object AS target, predicate FROM st WHERE object_type = 'PRODUCT'")
def graph_edges_of_products(t):
    """Links whose ends are both among the kept nodes (here: all but the untyped ones)."""
    df = statements(t)
    return export.drop_dangling(export.graph_edges(df), export.graph_nodes(df).where(F.col("type") != "UNKNOWN"))


def _rows(t):
    return statements(t).withColumns({
        "text": F.concat(F.lit('say "'), "source_text", F.lit('"')), "predicate_category": F.when(F.col("beam") > 0, "supply"),
        "sentiment": F.when(F.col("attempt") == 0, "neutral"), "relation_type": F.lit(None).cast("string"),
        "topics": F.split("source_text", " "), "canonical_predicate": F.when(F.col("beam") == 1, F.lit("supplier")),
        "confidence": F.when(F.col("beam") != 2, F.col("confidence"))})


RX = f"""{ST}, rx AS (SELECT *, 'say "' || source_text || '"' AS text, CASE WHEN beam > 0 THEN 'supply' END AS predicate_category, CASE WHEN attempt = 0 THEN 'neutral' END AS sentiment,
  string_split(source_text, ' ') AS topics, CASE WHEN beam = 1 THEN 'supplier' END AS canonical_predicate, CASE WHEN beam <> 2 THEN confidence END AS conf FROM st)"""
_F3 = "printf('%.3f', conf)"


@query("csv_rows", f"""WITH {RX} SELECT seq, '"' || subject || '",' || subject_type || ',"' || predicate || '",' || coalesce(predicate_category, '') || ',"' || object || '",' || object_type || ',"' || replace(text, '"', '""') || '",'
  || coalesce({_F3}, '') || ',' || coalesce(sentiment, '') || ',' || coalesce(predicate_category, '') || ',"' || array_to_string(list_slice(topics, 1, 3), '; ') || '"' AS line FROM rx""")
def csv_rows(t):
    df = _rows(t)
    return df.select("seq", export.csv_row(df).alias("line"))


def _e(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("xml_rows", f"""WITH {RX} SELECT seq, '  <stmt' || coalesce(' confidence="' || {_F3} || '"', '') || '>' || chr(10) || '    <subject type="' || subject_type || '">' || {_e('subject')} || '</subject>' || chr(10)
  || '    <predicate' || coalesce(' category="' || predicate_category || '"', '') || '>' || {_e('predicate')} || '</predicate>' || chr(10) || '    <object type="' || object_type || '">' || {_e('object')} || '</object>' || chr(10)
  || '    <text>' || {_e('text')} || '</text>' || CASE WHEN sentiment IS NULL THEN '' ELSE chr(10) || '    <labels>' || chr(10) || '      <label type="sentiment" confidence="0.500">' || sentiment || '</label>' || chr(10) || '    </labels>' END
  || chr(10) || '    <taxonomy>' || chr(10) || array_to_string(list_transform(list_slice(topics, 1, 5), lambda x: '      <topic category="c" confidence="1.000">' || x || '</topic>'), chr(10)) || chr(10) || '    </taxonomy>' || chr(10) || '  </stmt>' AS line FROM rx""")
def xml_rows(t):
    labels = F.array_compact(F.array(F.when(F.col("sentiment").isNotNull(), F.struct(
        F.lit("sentiment").alias("label_type"), F.col("sentiment").alias("label_value"), F.lit(0.5).alias("confidence")))))
    topics = F.transform("topics", lambda x: F.struct(F.lit("c").alias("category"), x.alias("label"), F.lit(1.0).alias("confidence")))
    return _rows(t).select("seq", export.export_xml(labels, topics).alias("line"))


CY = f"{RX}, {NODE_SQL}, nv AS (SELECT *, 'n' || (row_number() OVER (ORDER BY name, type) - 1) AS v FROM nd)"


@query("cypher_nodes", f"WITH {CY} SELECT name, type, v AS var, 'CREATE (' || v || ':' || type || ' {{name: ''' || name || '''}})' AS line FROM nv")
def cypher_nodes(t):
    return export.cypher_nodes(statements(t))


@query("cypher_edges", f"""WITH {CY} SELECT seq, 'CREATE (' || s.v || ')-[:' || regexp_replace(upper(coalesce(canonical_predicate, predicate)), '[^A-Z0-9]', '_', 'g') || ' {{predicate: ''' || predicate || ''''
  || coalesce(', canonical_predicate: ''' || canonical_predicate || '''', '') || coalesce(', category: ''' || predicate_category || '''', '') || coalesce(', confidence: ' || {_F3}, '') || coalesce(', sentiment: ''' || sentiment || '''', '')
  || ', topics: [' || array_to_string(list_transform(list_slice(topics, 1, 3), lambda x: '''' || x || ''''), ', ') || ']}}]->(' || o.v || ')' AS line
  FROM rx JOIN nv s ON s.name = subject AND s.type = subject_type JOIN nv o ON o.name = object AND o.type = object_type""")
def cypher_edges(t):
    return export.cypher_edges(_rows(t), export.cypher_nodes(statements(t))).select("seq", "line")


@query("statement_dicts", f"""WITH {ST} SELECT seq, subject AS subject_text, object AS object_name, predicate, source_text, 'b' AS sentiment, CAST(2 AS INTEGER) AS n_labels, 'p. ' || (beam + 1) AS citation, CAST(beam + 1 AS INTEGER) AS page FROM st""")
def statement_dicts(t):
    """The dictionary form written as JSON and read back field by field."""
    none = F.lit(None).cast("string")
    lab = lambda k, v: F.struct(F.lit(k).alias("label_type"), F.lit(v).alias("label_value"))
    df = statements(t).withColumns({
        "subject_fqn": F.col("subject"), "subject_canonical_id": none, "subject_name": none, "subject_qualifiers": F.create_map(F.lit("region"), F.lit("x")),
        "object_fqn": F.col("object"), "object_canonical_id": none, "object_name": F.col("object"), "object_qualifiers": F.lit(None).cast("map<string,string>"),
        "labels": F.array(lab("sentiment", "a"), lab("relation_type", "r"), lab("sentiment", "b")),
        "taxonomy": F.array(F.struct(F.lit("c").alias("category"), F.lit("l").alias("label"), F.lit(0.9).alias("confidence"))),
        "page_number": (F.col("beam") + 1).cast("int"), "citation": F.concat(F.lit("p. "), F.col("beam") + 1)})
    j = df.select("seq", export.statement_json(df).alias("j"))
    g = lambda path: F.get_json_object("j", path)
    return j.select("seq", g("$.subject.text").alias("subject_text"), g("$.object.name").alias("object_name"), g("$.predicate").alias("predicate"), g("$.source_text").alias("source_text"),
                    g("$.labels.sentiment").alias("sentiment"), F.size(F.from_json(g("$.labels"), "map<string,string>")).alias("n_labels"), g("$.citation").alias("citation"),
                    g("$.page_number").cast("int").alias("page"))


@query("parsed_answers", f"""WITH {ST} SELECT seq, CAST(0 AS INTEGER) AS stmt_idx, CASE WHEN beam = 2 THEN 'Legal ' || subject ELSE subject END AS subject, CASE WHEN beam = 0 THEN 'ORG' ELSE 'UNKNOWN' END AS subject_type, predicate, object,
  CASE WHEN beam % 2 = 1 THEN CASE WHEN beam = 1 THEN subject ELSE '' END || ' ' || predicate || ' ' || object ELSE source_text END AS text,
  CASE beam WHEN 0 THEN confidence WHEN 1 THEN confidence WHEN 2 THEN confidence ELSE NULL END AS confidence FROM st WHERE beam < 3 UNION ALL
  SELECT seq, CAST(0 AS INTEGER), subject, 'UNKNOWN', predicate, object, trim(subject || ' ' || predicate || ' ' || object), NULL FROM st WHERE beam = 3""")
def parsed_answers(t):
    """Exported answers in all shapes: flat list, flat labeled, nested labeled and a plain statements object."""
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    c = F.col
    s, o, p, src, conf = q(c("subject")), q(c("object")), q(c("predicate")), q(c("source_text")), c("confidence").cast("string")
    body = F.when(c("beam") == 0, cat('[{"subject": {"text": ', s, ', "type": " org "}, "predicate": ', p, ', "object": {"name": ', o, '}, "source_text": ', src, ', "confidence_score": ', conf, "}]")).when(
        c("beam") == 1, cat('{"labeled_statements": [{"subject": {"text": ', s, '}, "predicate": ', p, ', "object": {"text": ', o, '}, "labels": {"sentiment": "neutral", "confidence": ', conf, "}}]}")).when(
        c("beam") == 2, cat('{"labeled_statements": [{"statement": {"subject": {"text": ', s, '}, "predicate": ', p, ', "object": {"text": ', o, '}, "source_text": ', src, ', "confidence_score": ', conf,
                            '}, "subject_canonical": {"qualified_entity": {"qualifiers": {"legal_name": "Legal ', c("subject"), '"}}}, "object_canonical": {"canonical_match": {"canonical_name": ', o, '}}}]}')).otherwise(
        cat('{"statements": [{"subject": {"text": ', s, '}, "predicate": ', p, ', "object": {"text": ', o, '}}, {"subject": {"text": ""}, "predicate": "x", "object": {"text": "y"}}]}'))
    return export.parse_statements_json(statements(t).select("seq", body.alias("body")), "body").select(
        "seq", "stmt_idx", "subject", "subject_type", "predicate", "object", "text", "confidence")


@query("parsed_broken_xml", f"""WITH {ST} SELECT seq, CAST(0 AS INTEGER) AS stmt_idx, subject, subject_type, predicate, object, CASE WHEN object_type = 'UNKNOWN' THEN 'UNKNOWN' ELSE object_type END AS object_type, source_text AS text FROM st""")
def parsed_broken_xml(t):
    one = candidates.statement_xml(*[F.col(c) for c in ("subject", "subject_type", "predicate", "object", "object_type", "source_text")])
    df = statements(t).select("seq", F.concat(F.lit("<statements> & "), one, F.lit("<stmt><subject>only</subject></stmt> <unclosed")).alias("xml"))
    return export.parse_statements_regex(df, "xml").select("seq", "stmt_idx", "subject", "subject_type", "predicate", "object", "object_type", "text")


@query("read_answers", f"""WITH {ST}, x AS (SELECT *, CAST(substr(seq, 1, 2) AS INTEGER) AS k FROM st)
  SELECT seq, CASE WHEN k IN (1, 2) THEN 'json' WHEN k IN (3, 4) THEN 'xml' ELSE 'regex' END AS form, CAST(0 AS INTEGER) AS stmt_idx, subject, CASE WHEN k = 2 THEN 'UNKNOWN' ELSE subject_type END AS subject_type, predicate, object,
    CASE WHEN k IN (1, 2) THEN 'UNKNOWN' ELSE object_type END AS object_type, CASE WHEN k = 2 THEN subject || ' ' || predicate || ' ' || object ELSE source_text END AS text FROM x WHERE k < 7""")
def read_answers(t):
    """Answers in every form: JSON of two shapes, XML, XML behind a broken bracket, XML that does not close, nothing."""
    c = F.col
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    k = F.substring("seq", 1, 2).cast("int")
    one = candidates.statement_xml(*[c(x) for x in ("subject", "subject_type", "predicate", "object", "object_type", "source_text")])
    flat = cat('[{"subject": {"text": ', q(c("subject")), ', "type": "ORG"}, "predicate": ', q(c("predicate")), ', "object": {"name": ', q(c("object")), '}, "source_text": ', q(c("source_text")), "}]")
    labeled = cat('{"labeled_statements": [{"subject": {"text": ', q(c("subject")), '}, "predicate": ', q(c("predicate")), ', "object": {"text": ', q(c("object")), "}}]}")
    xml = cat("<statements>", one, "</statements>")
    body = (F.when(k == 1, flat).when(k == 2, cat("  ", labeled, " ")).when(k == 3, xml).when(k == 4, cat("\n", xml)).when(k == 5, cat("{ broken ", xml))
            .when(k == 6, cat("<statements> & ", one, "<stmt><subject>only</subject></stmt> <unclosed")).otherwise(F.lit(" ")))
    return export.read_answers(statements(t).select("seq", body.alias("body")), "body").select("seq", "form", *export.ANSWER_FIELDS)


_RAW_QUALIFIERS = """'{"legal_name": "' || s_name || ' </page>", "city": "  ", "org": 5, "ticker": "T' || s_suppkey || '", "identifiers": {"lei": "L' || s_suppkey || '", "ticker": "inner", "other": null, "n": 3}'
  || CASE s_suppkey % 4 WHEN 0 THEN ', "region": "' || n_name || '"' WHEN 1 THEN ', "region": null, "jurisdiction": "' || n_name || '"' WHEN 2 THEN ', "country": "' || n_name || ', PAGE"' ELSE ', "region": " none ", "country": "X"' END || '}'"""


@query("nested_qualifiers", """SELECT s_suppkey, s_name AS legal_name, CAST(NULL AS VARCHAR) AS org, 'T' || s_suppkey AS id_ticker, 'L' || s_suppkey AS id_lei, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE n_name END AS region,
  CAST(4 AS INTEGER) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def nested_qualifiers(t):
    """Qualifiers of exported JSON with nested identifiers, and the region they give."""
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.try_parse_json(F.expr(_RAW_QUALIFIERS)).alias("v"))
    m = x.select("s_suppkey", export.variant_qualifiers(F.col("v")).alias("m"), export.region_of(F.col("v")).alias("region"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("s_suppkey", get("legal_name").alias("legal_name"), get("org").alias("org"), get("id.ticker").alias("id_ticker"), get("id.lei").alias("id_lei"), "region", F.size("m").alias("n"))


@query("coerced_qualifiers", """SELECT s_suppkey, s_name AS legal_name, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS region, 'T' || s_suppkey AS id_ticker, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def coerced_qualifiers(t):
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.create_map(F.lit("legal_name"), F.concat("s_name", F.lit(" </page>")), F.lit("region"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(" none "),
                       F.lit("ticker"), F.concat(F.lit("T"), "s_suppkey"), F.lit("city"), F.lit("  "))
    m = x.select("s_suppkey", export.coerce_qualifiers(raw).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("s_suppkey", get("legal_name").alias("legal_name"), get("region").alias("region"), get("id.ticker").alias("id_ticker"), F.size("m").alias("n"))


@query("edited_statements", f"""WITH {ST} SELECT seq, subject, CASE WHEN beam = 1 THEN 'edited' ELSE predicate END AS predicate, object FROM st WHERE beam <> 2""")
def edited_statements(t):
    """An edit list applied: one beam is rewritten, one deleted."""
    df = statements(t)
    edits = df.where(F.col("beam").isin(1, 2)).select(
        "seq", F.when(F.col("beam") == 1, "update").otherwise("delete").alias("action"), F.when(F.col("beam") == 1, "edited").alias("new_predicate")).distinct()
    return export.apply_edits(df.select("seq", "subject", "predicate", "object"), edits, "seq")


@query("appended_statements", f"""WITH {ST} SELECT seq, subject, subject_type, CASE WHEN beam = 1 THEN 'edited' ELSE predicate END AS predicate, object FROM st WHERE beam <> 2
  UNION ALL SELECT seq || '+', '', 'UNKNOWN', CASE WHEN object_type = 'UNKNOWN' THEN 'new' ELSE '' END, '' FROM st WHERE beam = 3""")
def appended_statements(t):
    """An edit list that rewrites, deletes and appends: an appended row is blank where the edit says nothing."""
    df = statements(t)
    k = F.col("beam")
    edits = df.where(k.isin(1, 2, 3)).select(
        F.when(k == 3, F.concat("seq", F.lit("+"))).otherwise(F.col("seq")).alias("seq"), F.when(k == 1, "update").when(k == 2, "delete").otherwise("append").alias("action"),
        F.when(k == 1, "edited").when((k == 3) & (F.col("object_type") == "UNKNOWN"), "new").alias("new_predicate"))
    return export.apply_edits(df.select("seq", "subject", "subject_type", "predicate", "object"), edits, "seq")


@query("extraction_methods", "SELECT event_id, CASE event_type WHEN 'view' THEN 'hybrid' WHEN 'click' THEN 'model' WHEN 'error' THEN 'split' END AS method FROM events")
def extraction_methods(t):
    raw = F.when(F.col("event_type") == "view", " Hybrid").when(F.col("event_type") == "click", "MODEL").when(F.col("event_type") == "error", "split").otherwise("other")
    return t.events.select("event_id", export.extraction_method(raw).alias("method"))


@query("accepted_requests", "SELECT doc_id, length(trim(text)) BETWEEN 1 AND 10000 AS accepted FROM documents")
def accepted_requests(t):
    from ..sources.stores import accepted_text
    return t.documents.select("doc_id", accepted_text(F.col("text")).alias("accepted"))


@query("entity_display", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'C ' || s_name ELSE 'o ' || s_name END AS name FROM supplier""")
def entity_display(t):
    """Display name of an entity: its own name, else the canonical one, else the original text."""
    k = F.col("s_suppkey") % 3
    own, canon, orig = F.when(k == 0, F.concat("s_name", F.lit("</page>"))), F.when(k == 1, F.concat(F.lit("C "), "s_name")), F.concat(F.lit("o "), "s_name")
    return t.supplier.select("s_suppkey", tx.strip_page_tags(F.coalesce(own, canon, orig)).alias("name"))
