"""Country codes of free names: codes as they stand, names by edit distance over an index of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

EDITS = 2  # most edits between a name and its country's name
PER_EDIT = 4  # characters a name must have for each edit it may differ by
PREFIX = 12  # characters the index deletes from: texts within EDITS edits share a variant of their prefixes


def _shorter(s: Column) -> Column:
    """All texts that are s without one of its characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))


def deletions(c: Column) -> Column:
    """The prefix of c and what is left of it without any one or two of its characters: at most 79 texts, whatever c's length."""
    start = F.substring(c, 1, PREFIX)
    once = _shorter(start)
    return F.array_distinct(F.concat(F.array(start), once, F.flatten(F.transform(once, _shorter))))


def resolve_countries(names: DataFrame, name: str, countries: DataFrame) -> DataFrame:
    """(name, alpha_2, alpha_3, country_name, distance) of each distinct name, null where no country is near enough.

    A name that is a two-letter code, else a three-letter code, of countries(alpha_2, alpha_3, country_name) is that country;
    any other meets the countries with which it shares a deletion variant and takes the one with the fewest edits, at most
    EDITS and one for each PER_EDIT characters. Case and outer blanks don't count; ties go to the smaller country name, then
    code. No name meets all countries, and the shuffle carries variants of short prefixes, not names times countries.
    """
    once = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().withColumn("__key", tx.lower_strip(F.col("name")))
    keys = once.select("__key").where(F.col("__key") != "").distinct()
    known = countries.select("alpha_2", "alpha_3", "country_name", tx.lower_strip(F.col("country_name")).alias("__country"))
    chosen = lambda d: F.struct(d.alias("d"), "__country", "alpha_2", "alpha_3", "country_name").alias("__c")
    codes = known.select(F.lower("alpha_2").alias("__key"), chosen(F.lit(-2))).unionByName(known.select(F.lower("alpha_3").alias("__key"), chosen(F.lit(-1))))
    by_code = keys.join(codes, "__key")
    open_ = keys.join(by_code.select("__key"), "__key", "left_anti").withColumn("__v", F.explode(deletions(F.col("__key"))))
    allowed = F.least(F.lit(EDITS), F.floor(F.length("__key") / PER_EDIT))
    met = open_.join(known.withColumn("__v", F.explode(deletions(F.col("__country")))), "__v")
    met = met.withColumn("__d", F.levenshtein("__key", "__country", EDITS)).where((F.col("__d") >= 0) & (F.col("__d") <= allowed))
    best = by_code.unionByName(met.select("__key", chosen(F.col("__d")))).groupBy("__key").agg(F.min("__c").alias("__c"))
    return once.join(best, "__key", "left").select("name", "__c.alpha_2", "__c.alpha_3", "__c.country_name", F.greatest(F.col("__c.d"), F.when(F.col("__c").isNotNull(), 0)).alias("distance"))
