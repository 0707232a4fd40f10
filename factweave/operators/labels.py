"""Labelers and taxonomy topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions import text as tx
from ..functions.vectors import calibrate, calibrate_inverse
from .ranking import top_per_key
from .similarity import similarity_join

CATEGORIES = 1024  # centroids that may travel with a task
HIGH = {"canonical": 0.85, "label": 0.8, "topic": 0.7}


# ---- labels ----------------------------------------------------------------------------------

def sentiment(c: Column) -> Column:
    """struct<label,confidence> from counts of positive, negative and neutral words."""
    low = F.lower(c)
    count = lambda words: F.regexp_count(low, F.lit(tx.words_regex(words)))
    pos, neg, neu = count(fixed.POSITIVE_WORDS), count(fixed.NEGATIVE_WORDS), count(fixed.NEUTRAL_WORDS)
    total = pos + neg + neu
    conf = lambda n: F.least(F.lit(0.9), 0.6 + n / total * 0.3)
    pair = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("confidence"))
    return (F.when(total == 0, pair("neutral", F.lit(0.5)))
            .when((pos > neg) & (pos > neu), pair("positive", conf(pos)))
            .when((neg > pos) & (neg > neu), pair("negative", conf(neg)))
            .otherwise(pair("neutral", F.lit(0.6))))


def sentiment_label(df: DataFrame, precomputed: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Sentiment of predicate + source text; a precomputed (label, label_confidence) row overrides it.

    The rule runs only where nothing was computed before.
    """
    own = sentiment(F.concat_ws(" ", "predicate", "source_text"))
    if precomputed is None:
        return df.withColumn("__s", own).withColumns({"sentiment": F.col("__s.label"), "sentiment_confidence": F.col("__s.confidence")}).drop("__s")
    joined = df.join(precomputed, keys, "left").withColumn("__s", F.when(F.col("label").isNull(), own))
    return joined.withColumns({
        "sentiment": F.coalesce("label", "__s.label"),
        "sentiment_confidence": F.coalesce("label_confidence", "__s.confidence"),
    }).drop("__s", "label", "label_confidence")


def relation_type_label(df: DataFrame) -> DataFrame:
    """relation_type label rows; statements without a category have none."""
    return df.where(F.col("predicate_category").isNotNull()).withColumns({
        "label_type": F.lit("relation_type"), "label_value": F.col("predicate_category"), "label_confidence": F.col("confidence")})


def confidence_label(stmt: Column, subj: Column, obj: Column, subj_match: Column, obj_match: Column) -> Column:
    """Weighted mean of statement (.4), subject (.2), object (.2) and canonical match (.2) confidence.

    A missing statement confidence drops out of the mean; a missing match counts as 0.5.
    """
    match = (F.coalesce(subj_match, F.lit(0.5)) + F.coalesce(obj_match, F.lit(0.5))) / 2
    rest = subj * 0.2 + obj * 0.2 + match * 0.2
    mean = F.when(stmt.isNull(), rest / 0.6).otherwise((stmt * 0.4 + rest) / 1.0)
    # a tie that is only a binary rounding artefact is settled before the final rounding
    return F.round(F.round(mean, 9), 3)


def high_confidence(value: Column, kind: str) -> Column:
    return value >= HIGH[kind]


def labels_of_type(labels: Column, kind: str) -> Column:
    return F.filter(labels, lambda x: x["label_type"] == kind)


def first_label(labels: Column, kind: str) -> Column:
    return F.get(labels_of_type(labels, kind), F.lit(0))


def labeled_statements(statements: DataFrame, canonicals: DataFrame, key: str = "lookup_key") -> DataFrame:
    """Statements with the canonical form of both ends; ends without one fall back to their text.

    The canonical table is one row per distinct look-up key and is joined once per side.
    """
    out = statements
    for side in ("subject", "object"):
        c = canonicals.select(
            F.col(key).alias(f"{side}_key"), F.col("canonical_id").alias(f"{side}_canonical_id"),
            F.col("fqn").alias(f"{side}_fqn"), F.col("match_confidence").alias(f"{side}_match"))
        out = out.withColumn(f"{side}_key", tx.lower_strip(F.col(side))).join(c, f"{side}_key", "left").drop(f"{side}_key")
        out = out.withColumn(f"{side}_fqn", F.coalesce(f"{side}_fqn", side))
    return out


def with_canonicals(statements: DataFrame, found: DataFrame, stmt_id: str) -> DataFrame:
    """Statements with both ends' canonical entity from found(stmt_id, side, canonical_id, fqn, match_confidence); an end
    that was not found falls back to its text."""
    side = lambda name: F.max(F.when(F.col("side") == name, F.struct("canonical_id", "fqn", "match_confidence"))).alias(name)
    both = found.groupBy(stmt_id).agg(side("subject"), side("object")).select(
        stmt_id, *[F.col(f"{s}.{c}").alias(f"{s}_{a}") for s in ("subject", "object") for c, a in (("canonical_id", "canonical_id"), ("fqn", "fqn"), ("match_confidence", "match"))])
    out = statements.join(both, stmt_id, "left")
    return out.withColumns({f"{s}_fqn": F.coalesce(f"{s}_fqn", s) for s in ("subject", "object")})


# ---- topics ----------------------------------------------------------------------------------

def topic_classifier(embed, labels: list[tuple[str, str]], vectors, top_categories: int = 3, min_score: float = 0.8):
    """Column -> array<struct<category,label,confidence>> for a fixed label set held in the closure.

    `vectors` are the label vectors in label order; a few thousand labels at most.
    """
    m = np.array(vectors, dtype=np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cats = list(dict.fromkeys(c for c, _ in labels))
    member = np.array([[1.0 if c == cat else 0.0 for cat in cats] for c, _ in labels])
    member = member / member.sum(axis=0, keepdims=True)
    cat_of = np.array([cats.index(c) for c, _ in labels])

    @F.pandas_udf("array<struct<category:string,label:string,confidence:double>>")
    def run(texts: pd.Series) -> pd.Series:
        v = embed(texts)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        sims = np.divide(v, size, out=np.zeros_like(v), where=size > 0) @ m.T
        rank = np.argsort(np.argsort(-np.round(sims @ member, 9), axis=1, kind="stable"), axis=1)[:, cat_of]
        scores = 1 / (1 + np.exp(-25 * ((sims + 1) / 2 - 0.65)))
        row, at = np.nonzero((rank < top_categories) & (scores >= min_score))
        score = scores[row, at]
        best = np.lexsort((rank[row, at], -np.round(score, 9), row))  # stable: then in the labels' order
        hits = [{"category": labels[j][0], "label": labels[j][1], "confidence": round(c, 4)} for j, c in zip(at[best].tolist(), score[best].tolist())]
        ends = np.cumsum(np.bincount(row, minlength=len(v)))
        return pd.Series([hits[a:b] for a, b in zip([0, *ends[:-1]], ends)], dtype=object)

    return run


def _category_centroids(labels: DataFrame, category: str, vec: str) -> DataFrame:
    """Mean unit vector of each category: by linearity its dot product with a text vector is the mean similarity over the
    category's labels, so categories are ranked without visiting the labels."""
    doubles = F.transform(vec, lambda v: v.cast("double"))
    unit = labels.select(category, doubles.alias("v")).withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)))
    unit = unit.select(category, array_to_vector(F.transform("v", lambda v: v / F.col("n"))).alias("v"))
    return unit.groupBy(category).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def best_categories(texts: DataFrame, centroids: DataFrame, text_id: str, text_vec: str, category: str, k: int) -> DataFrame:
    """(text_id, category, category_score, category_rank, __v): the k categories of each text with the greatest dot product of
    its unit vector and their centroid, ties to the smaller category.

    Up to CATEGORIES centroids travel with the task; more of them are found by a similarity join, in which one more
    component makes each centroid a unit vector (and is 0 on the side of the texts), so that the product is a cosine.
    """
    few = centroids.where(F.col(category).isNotNull()).orderBy(category).limit(CATEGORIES + 1).collect()
    columns = texts.select(F.col(text_id), F.col(text_vec).alias("__v"))
    if len(few) > CATEGORIES:
        rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v * v)))
        wide = texts.select(text_id, F.array_append(F.transform(text_vec, lambda v: v.cast("double")), F.lit(0.0)).alias("w"))
        hits = similarity_join(wide, centroids.withColumn("centroid", F.array_append("centroid", rest)), text_id, "w", category, "centroid", k, -1.0)
        return hits.withColumnsRenamed({"similarity": "category_score", "rank": "category_rank"}).join(columns, text_id)
    m = np.array([r["centroid"] for r in few], dtype=np.float64)

    @F.pandas_udf("array<struct<at:int,category_score:double>>")
    def rank(vecs: pd.Series) -> pd.Series:
        if not len(m) or not len(vecs):
            return pd.Series([[]] * len(vecs))
        v = np.array(vecs.tolist(), dtype=np.float64)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        score = np.round(np.divide(v, size, out=np.zeros_like(v), where=size > 0) @ m.T, 9)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        return pd.Series([[{"at": int(j), "category_score": float(score[i, j])} for j in order[i]] for i in range(len(v))])

    names = F.array(*[F.lit(r[category]) for r in few]) if few else F.array().cast(T.ArrayType(centroids.schema[category].dataType))
    ranked = columns.where(F.col("__v").isNotNull()).select(text_id, "__v", F.posexplode(rank("__v")).alias("i", "c"))
    return ranked.select(text_id, F.get(names, F.col("c.at")).alias(category), "c.category_score", (F.col("i") + 1).alias("category_rank"), "__v")


def topics_hierarchical(texts: DataFrame, labels: DataFrame, text_id: str, text_vec: str, category: str, label: str,
                        label_vec: str, top_categories: int = 3, min_score: float = 0.8, k: int | None = None) -> DataFrame:
    """Topics of each text vector: labels of its best categories whose calibrated score reaches the minimum, of each
    category the k best (ties to the smaller label) if k is given.

    Category scores come from centroids; labels are then found by a threshold join inside the chosen
    categories, whose bound on the raw cosine follows from inverting the calibration.
    """
    chosen = best_categories(texts, _category_centroids(labels, category, label_vec), text_id, text_vec, category, top_categories)
    floor = calibrate_inverse(min_score) - 1e-9 if min_score > 0 else -1.0
    keyed = chosen.select(category, F.struct(F.col(text_id), F.col("category_rank"), F.col("category_score"), F.col(category)).alias("q"), "__v")
    hits = similarity_join(keyed, labels, "q", "__v", label, label_vec, k, floor, on=(category,))
    return hits.select("q.*", label, "similarity").withColumn("confidence", calibrate(F.col("similarity"))).where(F.col("confidence") >= min_score)


def topics_flat(texts: DataFrame, labels: DataFrame, text_id: str, text_vec: str, label: str, label_vec: str, k: int = 5,
                min_score: float = 0.0) -> DataFrame:
    """Best k labels of each text over the whole label set, with calibrated confidence."""
    floor = calibrate_inverse(min_score) - 1e-9 if min_score > 0 else -1.0
    hits = similarity_join(texts, labels, text_id, text_vec, label, label_vec, k, floor)
    return hits.withColumn("confidence", calibrate(F.col("similarity")))


def product_topics(category_scores: DataFrame, label_scores: DataFrame, key: str, top_categories: int = 3, min_score: float = 0.3) -> DataFrame:
    """Entailment topics: category score x label score inside the best categories, at or above the minimum."""
    best = top_per_key(category_scores, [key], [F.desc("category_score"), F.asc("category")], top_categories, "category_rank")
    both = best.join(label_scores, [key, "category"])
    return both.withColumn("confidence", F.round(F.col("category_score") * F.col("label_score"), 9)).where(F.col("confidence") >= min_score)


def topic_ids(topics: DataFrame, table: DataFrame) -> DataFrame:
    """label_id by (category, label), else by the label in any category (smallest category first)."""
    exact = table.select("category", "label", F.col("label_id").alias("__exact"))
    anywhere = table.groupBy("label").agg(F.min(F.struct("category", "label_id")).alias("a")).select("label", F.col("a.label_id").alias("__any"))
    return topics.join(exact, ["category", "label"], "left").join(anywhere, "label", "left").withColumn(
        "label_id", F.coalesce("__exact", "__any")).drop("__exact", "__any")


def flatten_topics(table: DataFrame) -> DataFrame:
    """Each category once followed by its labels, as (category, entry, is_category)."""
    cats = table.select("category").distinct().select("category", F.col("category").alias("entry"), F.lit(True).alias("is_category"))
    return cats.unionByName(table.select("category", F.col("label").alias("entry"), F.lit(False).alias("is_category")))
