"""Location dimension: label index, union of names, keys, foreign keys and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .ranking import dense_number


def label_index(labels: DataFrame, label: str, qid: str, order: str) -> DataFrame:
    """First qid of each lower-cased, stripped label."""
    keyed = labels.where(F.coalesce(label, F.lit("")) != "").select(
        tx.lower_strip(F.col(label)).alias("name_normalized"), F.struct(order, qid).alias("v"))
    return keyed.groupBy("name_normalized").agg(F.min("v").alias("m")).select("name_normalized", F.col(f"m.{qid}").alias("qid"))


def location_names(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct stripped non-blank names over several (table, column) pairs."""
    parts = [df.select(tx.strip(F.col(c)).alias("name")).where(F.col("name") != "") for df, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def qid_number(c: Column) -> Column:
    return F.when(c.rlike("^Q[0-9]+$"), F.substring(c, 2, 30)).try_cast("long")


def location_dimension(names: DataFrame, index: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Numbered locations in name order, with the qid of the normalised name and country codes."""
    keyed = names.withColumn("name_normalized", tx.lower_strip(F.col("name")))
    out = keyed.join(index, "name_normalized", "left").withColumn("qid", qid_number(F.col("qid")))
    if codes is not None:
        out = out.join(codes, "name_normalized", "left")
    out = out.withColumn("source", F.when(F.col("qid").isNotNull(), "wikidata").otherwise("pycountry"))
    return dense_number(out, ["name"], "location_id")


def assign_region(facts: DataFrame, region: str, dim: DataFrame) -> DataFrame:
    """Facts with region_id and the numeric source id; unmatched regions stay null."""
    table = F.create_map(*[F.lit(x) for kv in fixed.SOURCE_NUMBERS.items() for x in kv])
    ids = dim.select(F.col("name").alias("__region"), F.col("location_id").alias("region_id"))
    keyed = facts.withColumn("__region", tx.strip(F.col(region)))
    out = keyed.join(ids, "__region", "left").drop("__region")
    return out.withColumn("source_number", F.coalesce(table[F.col("source")], F.lit(4))) if "source" in facts.columns else out


def resolve_parents(locations: DataFrame, dim: DataFrame, key: str, parents: str, countries: str) -> DataFrame:
    """Ordered distinct parent ids per location: parents first, then countries; with a status.

    Status is resolved when every well-formed qid was found, partial when some were, else none.
    """
    tagged = F.transform(F.concat(F.coalesce(parents, F.array()), F.coalesce(countries, F.array())),
                         lambda q, i: F.struct(i.alias("i"), qid_number(q).alias("qid")))
    wanted = locations.select(key, F.explode(tagged).alias("w")).select(key, "w.*").where(F.col("qid").isNotNull())
    found = wanted.join(dim.select("qid", "location_id"), "qid", "left")
    # first position of each parent, then an ordered list whose length is bounded by the record itself
    each = found.groupBy(key, "location_id").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("location_id").isNotNull(), F.struct("i", "location_id")))), lambda s: s["location_id"])
    per = each.groupBy(key).agg(ids.alias("parent_ids"), F.sum(F.when(F.col("location_id").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))
    status = F.when(F.size("parent_ids") == 0, "none").when(F.col("unresolved") > 0, "partial").otherwise("resolved")
    return per.withColumn("status", status)


def missing_rows(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no entry yet."""
    return rows.join(done.select(key), key, "left_anti")


def backfill(rows: DataFrame, done: DataFrame, key: str, text: str, embed) -> DataFrame:
    """Existing vectors plus vectors for the rows that have none; each distinct text is embedded once."""
    todo = missing_rows(rows, done, key).select(key, text)
    once = todo.select(text).distinct().withColumn("embedding", embed(F.col(text)))
    return done.select(key, "embedding").unionByName(todo.join(once, text).select(key, "embedding"))
