"""Model output: split sentences, candidate statements in XML, repair and refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .ranking import first_per_key

SENTENCE = r"[^.!?\n]+[.!?]*"
STMT_SCHEMA = (
    "stmt array<struct<subject: struct<_VALUE: string, _type: string>, "
    "object: struct<_VALUE: string, _type: string>, predicate: string, text: string>>"
)


# ---- splitting -------------------------------------------------------------------------------

def sentence_array(c: Column) -> Column:
    """Default splitter: text up to a sentence mark or line end, stripped, blanks dropped."""
    parts = F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), tx.strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def split_sentences(df: DataFrame, text: str = "text", splitter=sentence_array) -> DataFrame:
    """One row per sentence with sent_idx; `splitter` is a Column -> array<string> provider."""
    return df.select("*", F.posexplode(splitter(F.col(text))).alias("sent_idx", "sentence"))


def split_xml(c: Column) -> Column:
    """Splitter answer in XML form for a text."""
    body = F.transform(sentence_array(c), lambda s: F.concat(F.lit("<stmt><text>"), s, F.lit("</text></stmt>")))
    return F.concat(F.lit("<statements>"), F.array_join(body, ""), F.lit("</statements>"))


def parse_split_xml(df: DataFrame, xml: str) -> DataFrame:
    """Sentences of a splitter answer: lazy match per <stmt>, stripped, blanks dropped, no dedup."""
    found = F.regexp_extract_all(F.col(xml), F.lit(fixed.SPLIT_SENTENCE), F.lit(1))
    kept = F.filter(F.transform(found, tx.strip), lambda s: F.length(s) > 0)
    return df.select("*", F.posexplode(kept).alias("sent_idx", "sentence"))


# ---- candidate XML ---------------------------------------------------------------------------

def _repair_steps():
    def truncated(x):
        for pattern, closer in fixed.TRUNCATED_CLOSERS:
            x = F.regexp_replace(x, pattern, closer)
        return x

    def root_closer(x):
        upto = F.regexp_extract(x, r"(?s)^(.*</stmt>)", 1)
        end = F.lit("</statements>")
        fixed = F.when(upto != "", F.concat(upto, end)).otherwise(F.concat(x, end))
        return F.when(x.contains("<statements>") & ~x.contains("</statements>"), fixed).otherwise(x)

    def statement_closers(x):
        missing = F.regexp_count(x, F.lit("<stmt>")) - F.regexp_count(x, F.lit("</stmt>"))
        closers = F.concat(F.repeat(F.lit("</stmt>"), missing), F.lit("</statements>"))
        return F.when((missing > 0) & x.contains("</statements>"), F.replace(x, F.lit("</statements>"), closers)).otherwise(x)

    def tail(x):
        at = F.instr(x, "</statements>")
        return F.when(at > 0, F.substring(x, F.lit(1), at + 12)).otherwise(x)

    return [
        ("ampersand", lambda x: F.regexp_replace(x, fixed.BARE_AMPERSAND, "&amp;")),
        ("less-than", lambda x: F.regexp_replace(
            x, r"<(?!(?:statements|stmt|subject|object|predicate|text)\b)(?=\s|[a-z]{2,}[^a-z/>])", "&lt;")),
        ("truncated closer", truncated), ("missing root closer", root_closer),
        ("missing statement closer", statement_closers), ("trailing content", tail),
    ]


def repair_xml(x: Column) -> Column:
    """struct<xml, repairs>: six ordered repairs; known tag names are never escaped.

    Each step is bound once, so the expression stays linear in the number of steps.
    """
    state = F.struct(x.alias("xml"), F.array().cast("array<string>").alias("repairs"))
    for name, step in _repair_steps():
        state = tx.bind(state, _apply(name, step))
    return state


def _apply(name: str, step):
    def run(s: Column) -> Column:
        noted = lambda y: F.when(y != s["xml"], F.array_append(s["repairs"], F.lit(name))).otherwise(s["repairs"])
        return tx.bind(step(s["xml"]), lambda y: F.struct(y.alias("xml"), noted(y).alias("repairs")))

    return run


def xml_statements(c: Column) -> Column:
    """The <stmt> elements of a well-formed answer with the right root, else null."""
    rooted = F.when(c.rlike(r"^\s*<statements[\s>/]"), c)
    return F.from_xml(rooted, STMT_SCHEMA)["stmt"]


def parse_statements_xml(df: DataFrame, xml: str, repair: bool = True) -> DataFrame:
    """One row per <stmt> with stmt_idx; repaired once if it does not parse; rows without subject or
    object are skipped, another root tag yields nothing."""
    parsed = xml_statements(F.col(xml))
    if repair:
        # the second parse is only evaluated where the first gave nothing
        parsed = F.coalesce(parsed, xml_statements(repair_xml(F.col(xml))["xml"]))
    return df.select("*", F.inline(statement_rows(parsed)))


def statement_rows(parsed: Column) -> Column:
    """The rows (stmt_idx, subject, ..., source_text) of parsed <stmt> elements that have a subject and an object, as an array:
    what is wrong is left out before the rows are, so that no filter behind them parses an answer again."""
    text = lambda c: F.coalesce(tx.strip(c), F.lit(""))
    kind = lambda c: F.coalesce(tx.parse_entity_type(c), F.lit("UNKNOWN"))
    rows = F.transform(parsed, lambda s, i: F.struct(
        i.alias("stmt_idx"), text(s["subject"]["_VALUE"]).alias("subject"), kind(s["subject"]["_type"]).alias("subject_type"), text(s["predicate"]).alias("predicate"),
        text(s["object"]["_VALUE"]).alias("object"), kind(s["object"]["_type"]).alias("object_type"), tx.blank_to_null(tx.strip(s["text"])).alias("source_text")))
    return F.filter(rows, lambda r: (r["subject"] != "") & (r["object"] != ""))


def statement_xml(subject: Column, subject_type: Column, predicate: Column, obj: Column, object_type: Column,
                  source: Column) -> Column:
    """<stmt> element; the type attribute is left out for UNKNOWN, <text> for no source."""

    def element(name: str, value: Column, kind: Column) -> Column:
        attr = F.when(kind == "UNKNOWN", F.lit("")).otherwise(F.concat(F.lit(' type="'), kind, F.lit('"')))
        return F.concat(F.lit(f"<{name}"), attr, F.lit(">"), _escape(value), F.lit(f"</{name}>"))

    body = F.when(F.coalesce(source, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit("<text>"), _escape(source), F.lit("</text>")))
    return F.concat(F.lit("<stmt>"), element("subject", subject, subject_type), element("object", obj, object_type),
                    F.lit("<predicate>"), _escape(predicate), F.lit("</predicate>"), body, F.lit("</stmt>"))


def _escape(c: Column) -> Column:
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(ent))
    return c


def longest_candidate(df: DataFrame, keys: list[str], xml: str, order: list[str]) -> DataFrame:
    """The longest candidate per key, first wins ties."""
    return first_per_key(df, keys, [F.desc(F.length(xml)), *[F.asc(c) for c in order]])


def deduplicated_xml(df: DataFrame, xml: str) -> DataFrame:
    """df with each answer's repeated <stmt> elements left out: the first of equal subject, predicate and object (stripped, lower
    case, absent as blank) stays, as it is written. An answer that does not parse or has another root is unchanged, and so is a
    null. The comparison is within one answer, which the model's output length bounds."""
    text = lambda c: tx.lower_strip(F.coalesce(c, F.lit("")))
    key = lambda s: F.struct(text(s["subject"]["_VALUE"]).alias("s"), text(s["predicate"]).alias("p"), text(s["object"]["_VALUE"]).alias("o"))
    written = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<stmt\b[^>]*/>|<stmt\b.*?</stmt>)"), F.lit(1))

    def single(found: Column) -> Column:
        kept = lambda keys: F.filter(found["r"], lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
        fresh = tx.bind(found["k"], lambda keys: F.concat(F.lit("<statements>"), F.array_join(kept(keys), ""), F.lit("</statements>")))
        return F.when(F.size(found["r"]) == F.size(found["k"]), fresh).otherwise(F.col(xml))

    # parsed once: the keys are null for an answer that does not parse, and then the answer stays
    keys = F.transform(xml_statements(F.col(xml)), key)
    whole = tx.bind(F.struct(keys.alias("k"), written.alias("r")), single)
    return df.withColumn(xml, F.when(F.col(xml).isNotNull(), whole))


def longest_raw_xml(df: DataFrame, keys: list[str], xml: str, attempt: str, expected: str, order: list[str]) -> DataFrame:
    """The longest answer per key after its repeated statements are left out, among the attempts up to the first in which an answer
    has `expected` statements; the first wins ties."""
    single = deduplicated_xml(df, xml).withColumn("__enough", F.coalesce(F.regexp_count(xml, F.lit("<stmt>")) >= F.col(expected), F.lit(False)))
    # the longest of an attempt's sufficient answers and of its others stand for the attempt: the answers are gone through once
    best = longest_candidate(single, [*keys, attempt, "__enough"], xml, order)
    stop = F.min(F.when(F.col("__enough"), F.col(attempt))).over(Window.partitionBy(*keys))
    tried = best.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col(attempt) <= F.col("__stop"))).drop("__stop", "__enough")
    return longest_candidate(tried, keys, xml, [attempt, *order])


def sufficient_attempts(df: DataFrame, keys: list[str], attempt: str, expected: str) -> DataFrame:
    """Rows of the attempts up to the first whose own statement total reaches `expected`.

    Totals are per (key, attempt); the first sufficient attempt is a min over those totals, so no
    per-key list of statements is ever built.
    """
    totals = df.groupBy(*keys, attempt).agg(F.count(F.lit(1)).alias("n"), F.max(expected).alias("need"))
    stop = totals.where(F.col("n") >= F.col("need")).groupBy(*keys).agg(F.min(attempt).alias("stop_at"))
    out = df.join(stop, keys, "left")
    return out.where(F.col("stop_at").isNull() | (F.col(attempt) <= F.col("stop_at"))).drop("stop_at")


# ---- refinement ------------------------------------------------------------------------------

def best_relation(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Best relation per statement: confidence, +0.2 if its head overlaps the model subject, +0.2
    if its tail overlaps the model object; first wins ties; a score must exceed 0.

    Columns: head, relation, tail, rel_confidence, subject, object.
    """

    def overlap(a: str, b: str) -> Column:
        x, y = F.lower(a), F.lower(b)
        return F.when(y.contains(x) | x.contains(y), 0.2).otherwise(0.0)

    score = F.col("rel_confidence") + overlap("subject", "head") + overlap("object", "tail")
    scored = df.withColumn("rel_score", F.round(score, 9)).where(F.col("rel_score") > 0)
    return first_per_key(scored, keys, [F.desc("rel_score"), *[F.asc(c) for c in order]])


def refine_boundary(mention: Column, entities: Column) -> Column:
    """Fold over entity texts: an entity that contains or is contained in the mention replaces the
    current text if it is at least as long."""
    low = F.lower(mention)

    def take(cur: Column, ent: Column) -> Column:
        e = F.lower(ent)
        return F.when((e.contains(low) | low.contains(e)) & (F.length(ent) >= F.length(cur)), ent).otherwise(cur)

    return F.aggregate(entities, mention, take)


def refined_candidates(df: DataFrame, use_relations: bool = True) -> DataFrame:
    """Candidates from model statements and refined (r_subject, r_predicate, r_object) columns.

    With refinement: a `hybrid` row, and a `gliner` row when the refined ends differ; without it,
    or without source text: the model's own predicate (`model`), blank predicates dropped.
    """
    refine = F.lit(use_relations) & (F.coalesce("source_text", F.lit("")) != "")

    def cand(s, p, o, method, ordinal):
        return F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"),
                        F.lit(method).alias("extraction_method"), F.lit(ordinal).alias("cand_idx"))

    has_pred = F.coalesce("r_predicate", F.lit("")) != ""
    both = (F.coalesce("r_subject", F.lit("")) != "") & (F.coalesce("r_object", F.lit("")) != "")
    differs = (F.col("r_subject") != F.col("subject")) | (F.col("r_object") != F.col("object"))
    options = F.array_compact(F.array(
        F.when(refine & has_pred, cand(F.col("subject"), F.col("r_predicate"), F.col("object"), "hybrid", 0)),
        F.when(refine & has_pred & both & differs,
               cand(F.col("r_subject"), F.col("r_predicate"), F.col("r_object"), "gliner", 1)),
        F.when(~refine & (F.coalesce("predicate", F.lit("")) != ""),
               cand(F.col("subject"), F.col("predicate"), F.col("object"), "model", 0)),
    ))
    rest = [c for c in df.columns if c not in ("subject", "predicate", "object", "r_subject", "r_predicate", "r_object")]
    return df.select(*rest, F.explode(options).alias("c")).select(*rest, "c.*")
