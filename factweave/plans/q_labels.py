"""Catalogue: labelers, labeled statements and taxonomy topics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import gram_counts
from ..operators import export, labels
from ..operators.relations import classify_distinct, predicate_category
from .derived import sql_low, statements, statements_sql
from .q_linking import CANON_SQL, canonicals
from .q_text import sentiment_sql
from .registry import query
from .sql import similarity_sql

ST = statements_sql()
_CATS = ", ".join(f"('{a}', '{b}')" for a, b, _ in fixed.PREDICATE_TABLE)
CATEGORY_SQL = f"pc(category, p) AS (VALUES {_CATS})"


@query("statement_sentiment", sentiment_sql(f"WITH {ST},", "predicate || ' ' || source_text", "seq", "st") + " SELECT seq, label AS sentiment, round(confidence, 4) AS confidence FROM sn")
def statement_sentiment(t):
    return labels.sentiment_label(statements(t)).select("seq", "sentiment", F.round("sentiment_confidence", 4).alias("confidence"))


@query("sentiment_override", sentiment_sql("WITH", "'said ' || text", "doc_id", "documents") + """ SELECT sn.doc_id, CASE WHEN l.doc_id IS NULL THEN label WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS sentiment,
  round(CASE WHEN l.doc_id IS NULL THEN confidence ELSE 0.95 END, 4) AS confidence FROM sn LEFT JOIN labels l ON l.doc_id = sn.doc_id""")
def sentiment_override(t):
    """Given document labels take precedence over the word rule."""
    given = t.labels.select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), F.lit(0.95).alias("label_confidence"))
    df = t.documents.select("doc_id", F.lit("said").alias("predicate"), F.col("text").alias("source_text"))
    return labels.sentiment_label(df, given, ["doc_id"]).select("doc_id", "sentiment", F.round("sentiment_confidence", 4).alias("confidence"))


@query("relation_type_labels", f"WITH {ST}, {CATEGORY_SQL} SELECT seq, 'relation_type' AS label_type, category AS label_value, confidence AS label_confidence FROM st JOIN pc ON p = replace(predicate, ' ', '_')")
def relation_type_labels(t):
    df = statements(t).withColumn("predicate_category", predicate_category(F.col("predicate")))
    return labels.relation_type_label(df).select("seq", "label_type", "label_value", "label_confidence")


_CONF = """CASE WHEN beam = 1 THEN NULL ELSE confidence END AS c, confidence AS sc, CAST(0.9 AS DOUBLE) AS oc"""


@query("confidence_labels", f"""WITH {ST}, {CANON_SQL}, x AS (SELECT seq, {_CONF}, s.match_confidence AS sm, o.match_confidence AS om FROM st LEFT JOIN ca s ON s.lookup_key = {sql_low('subject')} LEFT JOIN ca o ON o.lookup_key = {sql_low('object')}),
  y AS (SELECT *, sc * 0.2 + oc * 0.2 + (coalesce(sm, 0.5) + coalesce(om, 0.5)) / 2 * 0.2 AS rest FROM x) SELECT seq, round(round(CASE WHEN c IS NULL THEN rest / 0.6 ELSE c * 0.4 + rest END, 9), 3) AS confidence FROM y""")
def confidence_labels(t):
    df = _labeled(t)
    c = F.when(F.col("beam") != 1, F.col("confidence"))
    return df.select("seq", labels.confidence_label(c, F.col("confidence"), F.lit(0.9), F.col("subject_match"), F.col("object_match")).alias("confidence"))


def _labeled(t):
    orgs, parts = canonicals(t)
    return labels.labeled_statements(statements(t), orgs.unionByName(parts))


@query("labeled_statements", f"""WITH {ST}, {CANON_SQL} SELECT seq, predicate, s.canonical_id AS subject_canonical_id, coalesce(s.fqn, subject) AS subject_fqn, o.canonical_id AS object_canonical_id, coalesce(o.fqn, object) AS object_fqn
  FROM st LEFT JOIN ca s ON s.lookup_key = {sql_low('subject')} LEFT JOIN ca o ON o.lookup_key = {sql_low('object')}""")
def labeled_statements(t):
    return _labeled(t).select("seq", "predicate", "subject_canonical_id", "subject_fqn", "object_canonical_id", "object_fqn")


@query("high_confidence_flags", f"WITH {ST} SELECT seq, confidence >= 0.85 AS canonical_high, confidence >= 0.8 AS label_high, confidence >= 0.7 AS topic_high FROM st")
def high_confidence_flags(t):
    c = F.col("confidence")
    return statements(t).select("seq", *[labels.high_confidence(c, k).alias(f"{k}_high") for k in ("canonical", "label", "topic")])


def label_array():
    item = lambda a, b, c: F.struct(F.lit(a).alias("label_type"), b.cast("string").alias("label_value"), c.alias("confidence"))
    return F.array(item("sentiment", F.col("predicate"), F.col("confidence")), item("relation_type", F.col("object_type"), F.lit(0.9)),
                   item("sentiment", F.col("object"), F.lit(0.5)), item("confidence", F.col("beam"), F.lit(1.0)))


@query("label_lookups", f"""WITH {ST} SELECT seq, predicate AS first_sentiment, CAST(2 AS INTEGER) AS n_sentiment, object AS last_sentiment, object_type AS relation_type, CAST(3 AS INTEGER) AS shown_labels,
  array_to_string(list_slice(string_split(source_text, ' '), 1, 2), ',') AS shown_topics, CAST(greatest(len(string_split(source_text, ' ')) - 2, 0) AS INTEGER) AS hidden_topics FROM st""")
def label_lookups(t):
    """First / all / last label of a type, and the card view of labels and topics."""
    df = statements(t).withColumns({"labels": label_array(), "topics": F.split("source_text", " ")})
    last = export.last_label_map(F.col("labels"))
    df = df.withColumns({"card": export.card_view(F.col("labels"), F.col("topics"), 2), "last": last})
    return df.select("seq", labels.first_label(F.col("labels"), "sentiment")["label_value"].alias("first_sentiment"),
                     F.size(labels.labels_of_type(F.col("labels"), "sentiment")).alias("n_sentiment"), F.element_at("last", F.lit("sentiment")).alias("last_sentiment"),
                     F.element_at("last", F.lit("relation_type")).alias("relation_type"), F.size("card.labels").alias("shown_labels"),
                     F.array_join("card.topics", ",").alias("shown_topics"), F.col("card.hidden").alias("hidden_topics"))


# ---- topics ----------------------------------------------------------------------------------

TOPIC_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS t, b.vec_id AS topic, b.label AS category, list_cosine_similarity(a.v, b.v) AS sim FROM e a, e b),
  c AS (SELECT t, category, round(avg(sim), 9) AS cs FROM s GROUP BY ALL), cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY cs DESC, category) AS INTEGER) AS category_rank FROM c),
  ts AS (SELECT t, topic, category, sim, 1 / (1 + exp(-25 * ((sim + 1) / 2 - 0.65))) AS confidence FROM s)"""


@query("topics_hierarchical", f"WITH {TOPIC_SQL} SELECT t, category, category_rank, topic, round(confidence, 4) AS confidence FROM ts JOIN cr USING (t, category) WHERE category_rank <= 3 AND confidence >= 0.3")
def topics_hierarchical(t):
    e = t.embeddings
    texts = e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("tv"))
    table = e.select(F.col("label").alias("category"), F.col("vec_id").alias("topic"), "embedding")
    out = labels.topics_hierarchical(texts, table, "t", "tv", "category", "topic", "embedding", min_score=0.3)
    return out.select("t", "category", "category_rank", "topic", F.round("confidence", 4).alias("confidence"))


_FLAT = "WITH " + TOPIC_SQL + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY round(sim, 9) DESC, topic) AS INTEGER) AS rank FROM ts)"


@query("topics_flat", f"{_FLAT} SELECT t, rank, topic, round(confidence, 4) AS confidence FROM r WHERE rank <= 5")
def topics_flat(t):
    return _flat(t, 5).select("t", "rank", "topic", F.round("confidence", 4).alias("confidence"))


def _flat(t, k, min_score=0.0):
    e = t.embeddings
    return labels.topics_flat(e.select(F.col("vec_id").alias("t"), "embedding"), e.select(F.col("vec_id").alias("topic"), "embedding"), "t", "embedding", "topic", "embedding", k, min_score)


@query("topic_single_best", "WITH " + TOPIC_SQL + ", m AS (SELECT ts.*, row_number() OVER (PARTITION BY t ORDER BY round(sim, 9) DESC, category_rank, topic) AS rn FROM ts JOIN cr USING (t, category) WHERE category_rank <= 3 AND confidence >= 0.3) SELECT t, category, topic, round(confidence, 4) AS confidence FROM m WHERE rn = 1")
def topic_single_best(t):
    """Best label inside the best categories (the older single-answer labeler)."""
    from ..operators.ranking import first_per_key
    e = t.embeddings
    texts = e.select(F.col("vec_id").alias("t"), F.col("embedding").alias("tv"))
    table = e.select(F.col("label").alias("category"), F.col("vec_id").alias("topic"), "embedding")
    out = labels.topics_hierarchical(texts, table, "t", "tv", "category", "topic", "embedding", min_score=0.3, k=1)
    best = first_per_key(out, ["t"], [F.desc("similarity"), F.asc("category_rank"), F.asc("topic")])
    return best.select("t", "category", "topic", F.round("confidence", 4).alias("confidence"))


PRODUCT_SQL = """k AS (SELECT user_id, event_type AS category, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS label, count(*) AS n FROM events GROUP BY ALL),
  cn AS (SELECT user_id, category, sum(n) AS c FROM k GROUP BY ALL), cs AS (SELECT user_id, category, c / sum(c) OVER (PARTITION BY user_id) AS category_score FROM cn),
  ls AS (SELECT user_id, category, label, n / sum(n) OVER (PARTITION BY user_id, category) AS label_score FROM k)"""


@query("topics_by_product", f"""WITH {PRODUCT_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(category_score, 9) DESC, category) AS INTEGER) AS category_rank FROM cs)
  SELECT user_id, category, category_rank, CAST(label AS INTEGER) AS label, round(round(round(category_score, 9) * label_score, 9), 4) AS confidence FROM r JOIN ls USING (user_id, category) WHERE category_rank <= 3 AND round(round(category_score, 9) * label_score, 9) >= 0.1""")
def topics_by_product(t):
    """Entailment-style scores: a user's share per event type x share per k inside the type."""
    k = t.events.groupBy("user_id", F.col("event_type").alias("category"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    per_cat = k.groupBy("user_id", "category").agg(F.sum("n").alias("cn"))
    per_user = per_cat.groupBy("user_id").agg(F.sum("cn").alias("un"))
    cats = per_cat.join(per_user, "user_id").select("user_id", "category", F.round(F.col("cn") / F.col("un"), 9).alias("category_score"))
    labs = k.join(per_cat, ["user_id", "category"]).select("user_id", "category", "label", (F.col("n") / F.col("cn")).alias("label_score"))
    out = labels.product_topics(cats, labs, "user_id", min_score=0.1)
    return out.select("user_id", "category", "category_rank", "label", F.round("confidence", 4).alias("confidence"))


@query("topic_ids", """WITH tp AS (SELECT event_id, event_type AS category, 'k' || CAST(json_extract_string(props, '$.k') AS INTEGER) AS label FROM events),
  tb AS (SELECT category, label, min(event_id) AS label_id FROM tp WHERE category <> 'click' GROUP BY ALL), a AS (SELECT label, first(label_id ORDER BY category) AS any_id FROM tb GROUP BY 1)
  SELECT event_id, tp.category, tp.label, coalesce(tb.label_id, any_id) AS label_id FROM tp LEFT JOIN tb ON tb.category = tp.category AND tb.label = tp.label LEFT JOIN a ON a.label = tp.label""")
def topic_ids(t):
    """Topic ids by category and label; the click category has no entries of its own and falls back."""
    topics = t.events.select("event_id", F.col("event_type").alias("category"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("label"))
    table = topics.where(F.col("category") != "click").groupBy("category", "label").agg(F.min("event_id").alias("label_id"))
    return labels.topic_ids(topics, table).select("event_id", "category", "label", "label_id")


@query("flattened_topics", "WITH p AS (SELECT DISTINCT p_brand AS category, p_type AS label FROM part) SELECT category, label AS entry, false AS is_category FROM p UNION ALL SELECT DISTINCT category, category, true FROM p")
def flattened_topics(t):
    return labels.flatten_topics(_taxonomy(t))


def _taxonomy(t):
    return t.part.select(F.col("p_brand").alias("category"), F.col("p_type").alias("label")).distinct()


@query("taxonomy_totals", "SELECT count(DISTINCT p_brand) AS categories, count(DISTINCT p_brand || '/' || p_type) AS topics FROM part")
def taxonomy_totals(t):
    return _taxonomy(t).agg(F.countDistinct("category").alias("categories"), F.count(F.lit(1)).alias("topics"))


@query("taxonomy_preview", """WITH p AS (SELECT DISTINCT p_brand AS category, p_type AS label FROM part), c AS (SELECT DISTINCT category FROM p ORDER BY category LIMIT 4),
  r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY label) AS rn FROM p JOIN c USING (category)) SELECT category, label FROM r WHERE rn <= 3""")
def taxonomy_preview(t):
    """Preview: up to three topics of each of the first four categories."""
    from ..operators.ranking import top_per_key
    tax = _taxonomy(t)
    first = tax.select("category").distinct().orderBy("category").limit(4)
    return top_per_key(tax.join(first, "category"), ["category"], [F.asc("label")], 3).select("category", "label")


_TAX = ", ".join(f"({i}, {fixed.TAXONOMY_CATEGORIES.index(c)}, '{c}', '{lab}')" for i, (c, lab) in enumerate(fixed.TAXONOMY_TABLE))


@query("topics_by_text", f"""WITH {ST}, tx AS (SELECT DISTINCT source_text FROM st), lb(i, ci, category, label) AS (VALUES {_TAX}), {similarity_sql("SELECT source_text AS a, category || ' ' || label AS b FROM tx, lb")},
  p AS (SELECT a AS source_text, i, ci, category, label, s FROM sim JOIN lb ON b = category || ' ' || label), c AS (SELECT source_text, ci, round(avg(s), 9) AS cs FROM p GROUP BY ALL),
  cr AS (SELECT *, row_number() OVER (PARTITION BY source_text ORDER BY cs DESC, ci) AS rk FROM c), o AS (SELECT p.*, 1 / (1 + exp(-25 * ((s + 1) / 2 - 0.65))) AS confidence FROM p JOIN cr USING (source_text, ci) WHERE rk <= 3)
  SELECT seq, category, label, round(o.confidence, 4) AS confidence FROM st JOIN o USING (source_text) WHERE o.confidence >= 0.05""")
def topics_by_text(t):
    """Topics of statements from the authored taxonomy, classified once per distinct source text."""
    names = [f"{c} {lab}" for c, lab in fixed.TAXONOMY_TABLE]
    run = labels.topic_classifier(gram_counts, fixed.TAXONOMY_TABLE, gram_counts(pd.Series(names)), min_score=0.05)
    st = statements(t).select("seq", "source_text")
    once = classify_distinct(st, "source_text", lambda c: F.struct(run(c).alias("label"), F.lit(1.0).alias("confidence")))
    return once.select("seq", F.explode("label").alias("x")).select("seq", "x.category", "x.label", "x.confidence")
