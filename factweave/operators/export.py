"""Graph tables, CSV / XML / Cypher / JSON rows, and reading exported statements back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..sources.checkpoints import look_up
from . import candidates
from .linking import QUALIFIER_FIELDS
from .ranking import dense_number

CSV_HEADER = "subject,subject_type,predicate,predicate_category,object,object_type,text,confidence,sentiment,relation_type,topics"


# ---- graph -----------------------------------------------------------------------------------

def node_id(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def graph_nodes(df: DataFrame) -> DataFrame:
    """Distinct nodes `TYPE:name` of subjects and named objects."""
    ends = F.array(F.struct(F.col("subject_type").alias("type"), F.col("subject").alias("name")),
                   F.when(F.coalesce("object", F.lit("")) != "", F.struct(F.col("object_type").alias("type"), F.col("object").alias("name"))))
    rows = df.select(F.explode(F.array_compact(ends)).alias("n")).select("n.*").distinct()
    return rows.select(node_id(F.col("type"), F.col("name")).alias("id"), "name", "type")


def graph_edges(df: DataFrame) -> DataFrame:
    """One link per statement with a named object; links are not de-duplicated."""
    return df.where(F.coalesce("object", F.lit("")) != "").select(
        node_id(F.col("subject_type"), F.col("subject")).alias("source"),
        node_id(F.col("object_type"), F.col("object")).alias("target"), "predicate")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


# ---- rows ------------------------------------------------------------------------------------

def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def csv_row(df: DataFrame) -> Column:
    """One CSV line (11 columns, names and text quoted, confidence with 3 decimals, top 3 topics).

    Expects sentiment, relation_type, predicate_category, confidence, topics (array, best first).
    """
    col = F.col
    return F.concat_ws(
        ",", tx.quote_csv(col("subject")), col("subject_type"), tx.quote_csv(col("predicate")), _or_blank(col("predicate_category")),
        tx.quote_csv(col("object")), col("object_type"), tx.quote_csv(col("text")), _or_blank(tx.fixed3(col("confidence"))),
        _or_blank(col("sentiment")), _or_blank(F.coalesce("relation_type", "predicate_category")),
        F.concat(F.lit('"'), F.array_join(F.slice("topics", 1, 3), "; "), F.lit('"')))


def export_xml(labels: Column | None = None, topics: Column | None = None) -> Column:
    """<stmt> element with optional <labels> (all) and <taxonomy> (first 5)."""
    esc, col = tx.escape_xml, F.col
    attr = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))

    def block(items: Column | None, tag: str, line) -> Column:
        if items is None:
            return F.lit("")
        body = F.concat(F.lit(f"\n    <{tag}>\n"), F.array_join(F.transform(items, line), "\n"), F.lit(f"\n    </{tag}>"))
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, body).otherwise("")

    label_line = lambda x: F.concat(
        F.lit('      <label type="'), esc(x["label_type"]), F.lit('" confidence="'), tx.fixed3(x["confidence"]), F.lit('">'),
        esc(x["label_value"]), F.lit("</label>"))
    topic_line = lambda x: F.concat(
        F.lit('      <topic category="'), esc(x["category"]), F.lit('" confidence="'), tx.fixed3(x["confidence"]), F.lit('">'),
        esc(x["label"]), F.lit("</topic>"))
    return F.concat(
        F.lit("  <stmt"), attr("confidence", tx.fixed3(col("confidence"))), F.lit(">\n    <subject type=\""), col("subject_type"),
        F.lit('">'), esc(col("subject")), F.lit("</subject>\n    <predicate"),
        attr("category", esc(tx.blank_to_null(col("predicate_category")))), F.lit(">"), esc(col("predicate")),
        F.lit("</predicate>\n    <object type=\""), col("object_type"), F.lit('">'), esc(col("object")),
        F.lit("</object>\n    <text>"), esc(col("text")), F.lit("</text>"), block(labels, "labels", label_line),
        block(F.slice(topics, 1, 5) if topics is not None else None, "taxonomy", topic_line), F.lit("\n  </stmt>"))


def _cypher_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_nodes(df: DataFrame) -> DataFrame:
    """Numbered node table (type, name, var) and its CREATE line; numbers follow the sorted node key."""
    ends = F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")),
                   F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))
    rows = df.select(F.explode(ends).alias("n")).select("n.*").distinct()
    numbered = dense_number(rows, ["name", "type"], "n", start=0)
    var = F.concat(F.lit("n"), F.col("n").cast("string"))
    line = F.concat(F.lit("CREATE ("), var, F.lit(":"), F.col("type"), F.lit(" {name: "), _cypher_quote(F.col("name")), F.lit("})"))
    return numbered.select("name", "type", var.alias("var"), line.alias("line"))


def cypher_edges(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """CREATE line of every statement, naming the node variables."""
    nodes = look_up(nodes.select("name", "type", "var"))
    end = lambda side: nodes.select(F.col("name").alias(side), F.col("type").alias(f"{side}_type"), F.col("var").alias(f"{side}_var"))
    both = df.join(end("subject"), ["subject", "subject_type"]).join(end("object"), ["object", "object_type"])
    rel = F.regexp_replace(F.upper(F.coalesce(tx.blank_to_null(F.col("canonical_predicate")), F.col("predicate"))), "[^A-Z0-9]", "_")
    opt = lambda name, value: F.coalesce(F.concat(F.lit(f", {name}: "), value), F.lit(""))
    topics = F.slice("topics", 1, 3)
    topic_list = F.when(F.size(topics) > 0, F.concat(F.lit("["), F.array_join(F.transform(topics, _cypher_quote), ", "), F.lit("]")))
    line = F.concat(
        F.lit("CREATE ("), F.col("subject_var"), F.lit(")-[:"), rel, F.lit(" {predicate: "), _cypher_quote(F.col("predicate")),
        opt("canonical_predicate", _cypher_quote(tx.blank_to_null(F.col("canonical_predicate")))),
        opt("category", _cypher_quote(tx.blank_to_null(F.col("predicate_category")))), opt("confidence", tx.fixed3(F.col("confidence"))),
        opt("sentiment", F.concat(F.lit("'"), F.col("sentiment"), F.lit("'"))), opt("topics", topic_list),
        F.lit("}]->("), F.col("object_var"), F.lit(")"))
    return both.withColumn("line", line)


def statement_json(df: DataFrame) -> Column:
    """The simplified dictionary form of a labeled statement as JSON; the last label of a type wins."""
    def entity(side: str) -> Column:
        return F.struct(F.col(side).alias("text"), F.col(f"{side}_type").alias("type"), F.col(f"{side}_fqn").alias("fqn"),
                        F.col(f"{side}_canonical_id").alias("canonical_id"), F.col(f"{side}_name").alias("name"),
                        F.col(f"{side}_qualifiers").alias("qualifiers"))

    return F.to_json(F.struct(
        entity("subject").alias("subject"), F.col("predicate"), entity("object").alias("object"), F.col("source_text"),
        last_label_map(F.col("labels")).alias("labels"), F.col("taxonomy"), F.col("doc_id").alias("document_id"),
        F.col("page_number"), F.col("citation")))


def last_label_map(labels: Column) -> Column:
    """map<label_type,label_value> in which the last label of a type wins."""
    n = F.size(labels)
    later = lambda i, x: F.exists(F.slice(labels, i + 2, n), lambda y: y["label_type"] == x["label_type"])
    kept = F.filter(F.transform(labels, lambda x, i: F.struct(
        F.when(~later(i, x), x["label_type"]).alias("k"), x["label_value"].alias("v"))), lambda e: e["k"].isNotNull())
    return F.map_from_entries(kept)


# ---- reading back ----------------------------------------------------------------------------

_ENTITY = "struct<text: string, type: string, name: string, fqn: string, canonical_id: string>"
_FLAT = f"subject: {_ENTITY}, object: {_ENTITY}, predicate: string, predicate_category: string, source_text: string, " \
        "confidence_score: double, canonical_predicate: string, extraction_method: string"
_CANON = "struct<name: string, fqn: string, canonical_match: struct<canonical_id: string, canonical_name: string>, " \
         "qualified_entity: struct<original_text: string, entity_type: string, qualifiers: struct<legal_name: string>>>"
_LABELED = f"{_FLAT}, labels: map<string,string>, statement: struct<{_FLAT}>, subject_canonical: {_CANON}, object_canonical: {_CANON}"


def parse_statements_json(df: DataFrame, body: str) -> DataFrame:
    """One row per statement of an exported JSON answer in any of its three shapes: a list (or
    {"statements": []}), {"labeled_statements": [flat]} and {"labeled_statements": [nested]}.

    Rows without subject name or predicate are dropped; missing text becomes "S P O".
    """
    return df.select("*", F.inline(json_rows(F.col(body))))


def json_rows(c: Column) -> Column:
    """The rows of `parse_statements_json` as an array: each answer is parsed once, and no filter behind the rows parses it again."""
    is_list = c.startswith("[")
    plain = F.when(is_list, F.from_json(c, f"array<struct<{_FLAT}>>")).otherwise(
        F.from_json(F.get_json_object(c, "$.statements"), f"array<struct<{_FLAT}>>"))
    labeled = F.when(~is_list, F.from_json(F.get_json_object(c, "$.labeled_statements"), f"array<struct<{_LABELED}>>"))

    def name_of(e: Column) -> Column:
        return tx.strip_page_tags(F.coalesce(tx.blank_to_null(tx.strip(e["name"])), tx.blank_to_null(tx.strip(e["text"])), F.lit("")))

    def canon_name(c: Column, fallback: Column) -> Column:
        return tx.strip_page_tags(F.coalesce(*[tx.blank_to_null(x) for x in (
            tx.strip(c["name"]), c["qualified_entity"]["qualifiers"]["legal_name"], c["canonical_match"]["canonical_name"],
            c["qualified_entity"]["original_text"], fallback)], F.lit("")))

    def row(i: Column, s: Column, subject: Column, obj: Column, s_text: Column, o_text: Column, conf: Column) -> Column:
        return F.struct(
            i.alias("stmt_idx"), subject.alias("subject"), tx.parse_entity_type(F.coalesce(s["subject"]["type"], F.lit("")), True).alias("subject_type"),
            F.coalesce(s["predicate"], F.lit("")).alias("predicate"), obj.alias("object"),
            tx.parse_entity_type(F.coalesce(s["object"]["type"], F.lit("")), True).alias("object_type"),
            F.coalesce(tx.blank_to_null(s["source_text"]), tx.strip(F.concat_ws(
                " ", F.coalesce(s_text, F.lit("")), F.coalesce(s["predicate"], F.lit("")), F.coalesce(o_text, F.lit(""))))).alias("text"),
            conf.alias("confidence"), s["predicate_category"].alias("predicate_category"))

    flat = lambda i, s, conf: row(i, s, name_of(s["subject"]), name_of(s["object"]), s["subject"]["text"], s["object"]["text"], conf)

    def from_labeled(x: Column, i: Column) -> Column:
        st = x["statement"]
        names = F.struct(canon_name(x["subject_canonical"], st["subject"]["text"]).alias("s"), canon_name(x["object_canonical"], st["object"]["text"]).alias("o"))
        nested = tx.bind(names, lambda n: row(i, st, n["s"], n["o"], n["s"], n["o"], st["confidence_score"]))
        return F.when(st.isNotNull(), nested).otherwise(flat(i, x, x["labels"]["confidence"].try_cast("double")))

    rows = tx.bind(labeled, lambda found: F.when(F.size(found) > 0, F.transform(found, from_labeled)).otherwise(
        F.transform(plain, lambda s, i: flat(i, s, s["confidence_score"]))))
    return F.filter(rows, lambda r: (r["subject"] != "") & (r["predicate"] != ""))


def parse_statements_regex(df: DataFrame, xml: str) -> DataFrame:
    """Fallback for broken XML: <stmt> blocks by regex, fields by regex; needs subject and predicate."""
    return df.select("*", F.inline(regex_rows(F.col(xml))))


def regex_rows(c: Column) -> Column:
    """The rows of `parse_statements_regex` as an array."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)<stmt>(.*?)</stmt>"), F.lit(1))
    pick = lambda b, tag: tx.strip(F.regexp_extract(b, rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    entity = lambda b, tag, g: F.regexp_extract(b, rf'(?s)<{tag}(?:\s+type="([^"]*)")?>(.*?)</{tag}>', g)
    rows = F.transform(blocks, lambda b, i: F.struct(
        i.alias("stmt_idx"), tx.strip(entity(b, "subject", 2)).alias("subject"), tx.parse_entity_type(entity(b, "subject", 1), True).alias("subject_type"),
        tx.strip(entity(b, "object", 2)).alias("object"), tx.parse_entity_type(entity(b, "object", 1), True).alias("object_type"),
        pick(b, "predicate").alias("predicate"), pick(b, "text").alias("text")))
    spoken = lambda r: F.coalesce(tx.blank_to_null(r["text"]), tx.strip(F.concat_ws(" ", r["subject"], r["predicate"], r["object"])))
    kept = F.filter(rows, lambda r: (r["subject"] != "") & (r["predicate"] != ""))
    return F.transform(kept, lambda r: r.withField("text", spoken(r)))


def coerce_qualifiers(raw: Column) -> Column:
    """map of cleaned qualifiers: known fields keep their name, any other key becomes "id.<key>";
    blank values and NONE placeholders are dropped."""
    known = [*QUALIFIER_FIELDS, "source", "source_id"]
    cleaned = F.transform_values(raw, lambda _, v: tx.strip_page_tags(v))
    kept = F.map_filter(cleaned, lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.transform_keys(kept, lambda k, _: F.when(k.isin(*known), k).otherwise(F.concat(F.lit("id."), k)))


def variant_qualifiers(raw: Column) -> Column:
    """`coerce_qualifiers` of a JSON object given as a VARIANT: keys of a nested `identifiers` object are identifiers too, a
    key beside it wins over one inside it, and only strings count. Null for no object or nothing left."""
    strings = lambda v: F.map_filter(F.transform_values(v.cast("map<string,variant>"), lambda _, x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda _, x: x.isNotNull())
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    nested = F.try_variant_get(raw, "$.identifiers", "variant")
    inner = F.transform_keys(F.when(is_object(nested), strings(nested)), lambda k, _: F.concat(F.lit("id."), k))
    inner = F.map_filter(F.transform_values(inner, lambda _, v: tx.strip_page_tags(v)), lambda _, v: v != "")
    outer = coerce_qualifiers(F.map_filter(F.when(is_object(raw), strings(raw)), lambda k, _: k != "identifiers"))
    none = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce(inner, none), lambda k, _: ~F.map_contains_key(F.coalesce(outer, none), k)), F.coalesce(outer, none))
    return F.when(F.size(both) > 0, both)


def region_of(q: Column) -> Column:
    """Region of qualifiers given as a VARIANT: the first of region, jurisdiction and country that is there at all, cleaned; a
    first one that is blank or no string gives none."""
    field = lambda name: F.try_variant_get(q, f"$.{name}", "variant")
    given = lambda v: F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "VOID", v)
    first = F.coalesce(*[given(field(n)) for n in ("region", "jurisdiction", "country")])
    return tx.blank_to_null(tx.strip_page_tags(F.when(F.schema_of_variant(first) == "STRING", first.cast("string"))))


ANSWER_FIELDS = ["stmt_idx", "subject", "subject_type", "predicate", "object", "object_type", "text"]


def read_answers(df: DataFrame, body: str) -> DataFrame:
    """One row per statement of an answer in any form, with `form`: JSON if it looks like JSON and parses, else well-formed
    XML, else what regular expressions find in it. Each form is only tried on the answers that failed before it; null and
    blank answers give nothing."""
    def read(b: Column) -> Column:
        fields = lambda form, text: lambda r: F.struct(F.lit(form).alias("form"), *[(text(r) if n == "text" else r[n]).alias(n) for n in ANSWER_FIELDS])
        given, spoken = lambda r: r["text"], lambda r: F.coalesce(r["source_text"], tx.strip(F.concat_ws(" ", r["subject"], r["predicate"], r["object"])))
        parts = lambda found: F.transform(F.filter(candidates.statement_rows(found), lambda r: r["predicate"] != ""), fields("xml", spoken))
        other = tx.bind(candidates.xml_statements(b), lambda found: F.when(found.isNotNull(), parts(found)).otherwise(F.transform(regex_rows(b), fields("regex", given))))
        is_json = b.rlike(r"^[\[{]") & F.try_parse_json(b).isNotNull()
        return F.when(b != "", F.when(is_json, F.transform(json_rows(b), fields("json", given))).otherwise(other))

    # one pass over the answers, each parsed once in each form that it is tried in
    return df.select("*", F.inline(tx.bind(tx.strip(F.col(body)), read)))


def extraction_method(c: Column) -> Column:
    m = F.lower(tx.strip(c))
    return F.when(m.isin(*fixed.EXTRACTION_METHODS), m)


def card_view(labels: Column, topics: Column, shown: int = 3) -> Column:
    """struct<labels,topics,hidden>: confidence labels hidden, first topics and how many are not shown."""
    return F.struct(
        F.filter(labels, lambda x: x["label_type"] != "confidence").alias("labels"), F.slice(topics, 1, shown).alias("topics"),
        F.greatest(F.size(topics) - shown, F.lit(0)).alias("hidden"))


def apply_edits(statements: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Statement table after an edit list (key, action update|delete|append, new_subject/predicate/object). An update or a
    deletion of a key that is not there does nothing; an appended row is blank where the edit gives no value."""
    joined = statements.join(edits.where(F.col("action") != "append"), key, "left").where(~F.col("action").eqNullSafe("delete"))
    fresh = lambda c: F.when(F.col("action") == "update", F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c)
    kept = joined.select(*[fresh(c) if f"new_{c}" in edits.columns else F.col(c) for c in statements.columns])
    blank = lambda c: F.lit("UNKNOWN") if c.endswith("_type") else F.lit("")
    given = lambda c: F.coalesce(f"new_{c}", blank(c)) if f"new_{c}" in edits.columns else blank(c)
    added = edits.where(F.col("action") == "append").select(*[F.col(c) if c == key else given(c).alias(c) for c in statements.columns])
    return kept.unionByName(added)
