"""Mentions, candidate acceptance, qualifiers, canonical names and organisation look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..sources.checkpoints import look_up
from .containment import containment_join
from .ranking import first_per_key
from .similarity import similarity_join

ORG_TOP_K, ORG_MIN_SIM, ACCEPT = 20, 0.3, 0.85


def mentions(statements: DataFrame, stmt_id: str) -> DataFrame:
    """Subjects and objects as rows (stmt_id, side, entity_ref, mention, mention_type, lookup_key)."""
    ends = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("mention"), F.col(f"{side}_type").alias("mention_type"))
        for side in ("subject", "object")
    ])
    rows = statements.select(stmt_id, F.explode(ends).alias("e")).select(stmt_id, "e.*")
    return rows.withColumns({
        "entity_ref": F.sha2(F.concat_ws("\u0001", F.col(stmt_id).cast("string"), "side"), 256),
        "lookup_key": tx.lower_strip(F.col("mention")),
    })


def distinct_lookups(mention_rows: DataFrame) -> DataFrame:
    """One row per (lookup_key, mention_type): what has to be looked up once."""
    return mention_rows.groupBy("lookup_key", "mention_type").agg(
        F.min("mention").alias("mention"), F.count(F.lit(1)).alias("mentions"))


def knn_candidates(queries: DataFrame, records: DataFrame, query_id: str, record_id: str, vec: str = "embedding",
                   k: int = ORG_TOP_K, min_sim: float = ORG_MIN_SIM) -> DataFrame:
    return similarity_join(queries, records, query_id, vec, record_id, vec, k, min_sim)


def accept_top(candidates: DataFrame, score: str = "similarity", threshold: float = ACCEPT) -> DataFrame:
    """Without an arbiter: the best candidate, if it is good enough."""
    return candidates.where((F.col("rank") == 1) & (F.col(score) >= threshold))


def arbiter_choice(answer: Column, shown: Column) -> Column:
    """0-based index chosen by an arbiter's answer, null for NONE, junk or anything not shown."""
    a = tx.strip(answer)
    n = F.when(a.rlike(r"^[+-]?[0-9]{1,9}$"), a).try_cast("int")
    return F.when((n >= 1) & (n <= shown), n - 1)


def arbitrate(candidates: DataFrame, answers: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """The candidate an arbiter picked among the `shown` best; no valid answer means no match."""
    counts = candidates.where(F.col("rank") <= shown).groupBy(key).agg(F.count(F.lit(1)).alias("shown"))
    picked = answers.join(counts, key).withColumn("pick", arbiter_choice(F.col("answer"), F.col("shown")))
    picked = picked.where(F.col("pick").isNotNull()).select(key, (F.col("pick") + 1).alias("rank"))
    return candidates.join(picked, [key, "rank"])


def source_prefix(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.SOURCE_PREFIXES.items() for x in kv])
    return F.coalesce(table[source], F.upper(source))


def org_fqn(name: Column, source: Column, region: Column) -> Column:
    return F.concat(name, F.lit(" ("), F.concat_ws(",", source_prefix(source), tx.blank_to_null(region)), F.lit(")"))


def org_identifiers(source: Column, source_id: Column, ticker: Column) -> Column:
    """Identifier map of an organisation record; absent entries are left out."""
    prefix = source_prefix(source)
    entries = {
        "source": prefix, "source_id": source_id, "canonical_id": F.concat(prefix, F.lit(":"), source_id),
        "lei": F.when(source == "gleif", source_id), "sec_cik": F.when(source == "sec_edgar", source_id),
        "ticker": F.when(source == "sec_edgar", tx.blank_to_null(ticker)),
        "ch_number": F.when(source == "companies_house", source_id),
    }
    return filled_map(entries)


def filled_map(entries: dict[str, Column]) -> Column:
    """map<string,string> of the entries whose value is not null."""
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def default_fqn(base: Column, role: Column, org: Column, ticker: Column, jurisdiction: Column) -> Column:
    """"base (role, org, ticker, jurisdiction)": blanks and case-insensitive repeats dropped,
    jurisdiction only without an organisation."""
    has_org = F.coalesce(org, F.lit("")) != ""
    parts = F.filter(F.array(role, org, ticker, F.when(~has_org, jurisdiction)), lambda x: F.coalesce(x, F.lit("")) != "")
    fresh = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return F.when(F.size(fresh) > 0, F.concat(base, F.lit(" ("), F.array_join(fresh, ", "), F.lit(")"))).otherwise(base)


QUALIFIER_FIELDS = ["legal_name", "org", "role", "region", "country", "city", "jurisdiction"]


def merge_qualifiers(a: Column, b: Column, fields: list[str] = QUALIFIER_FIELDS) -> Column:
    """Field by field the right value if non-empty, else the left; identifier maps merge to the right."""
    merged = [F.coalesce(tx.blank_to_null(b[f]), a[f]).alias(f) for f in fields]
    left, right = a["identifiers"], b["identifiers"]
    ids = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    return F.struct(*merged, ids.alias("identifiers"))


def has_any_qualifier(q: Column, fields: list[str] = QUALIFIER_FIELDS) -> Column:
    filled = reduce(lambda x, y: x | y, [F.coalesce(q[f], F.lit("")) != "" for f in fields])
    return filled | (F.coalesce(F.size(q["identifiers"]), F.lit(0)) > 0)


def qualifier_dict(q: Column) -> Column:
    """Serialised qualifiers: legal_name, region (region, else jurisdiction, else country), source,
    source_id; null when nothing is set."""
    region = F.coalesce(*[tx.blank_to_null(q[f]) for f in ("region", "jurisdiction", "country")])
    m = filled_map({
        "legal_name": tx.blank_to_null(q["legal_name"]), "region": region,
        "source": F.try_element_at(q["identifiers"], F.lit("source")),
        "source_id": F.try_element_at(q["identifiers"], F.lit("source_id"))})
    return F.when(F.size(m) > 0, m)


def first_result(results: list[tuple[int, DataFrame]], key: str) -> DataFrame:
    """Results of several plugins with priorities: per key the lowest priority wins."""
    tagged = [df.withColumn("priority", F.lit(p)) for p, df in results]
    return first_per_key(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), [key], [F.asc("priority")])


def with_fallback(mention_rows: DataFrame, canonicals: DataFrame, key: str) -> DataFrame:
    """Every mention with its canonical name and fqn; unmatched ones fall back to their own text."""
    out = mention_rows.join(look_up(canonicals), key, "left")
    return out.withColumns({
        "matched": F.col("canonical_id").isNotNull(),
        "canonical_name": F.coalesce("canonical_name", "mention"), "fqn": F.coalesce("fqn", "mention")})


def strip_filer_suffixes(c: Column) -> Column:
    """Every occurrence of each suffix removed, in list order."""
    for s in fixed.FILER_SUFFIXES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return tx.strip(c)


def filer_match(names: DataFrame, filers: DataFrame, name: str, filer: str, order: str) -> DataFrame:
    """Filer of each name: exact, else first containing or contained, else the same on suffix-less
    names. Tiers 1-3; inside a tier the smallest `order` wins.

    Containment goes through an index on character grams, never through all pairs.
    """
    q = names.select(name).distinct().withColumn("__q", tx.lower_strip(F.col(name)))
    q = q.withColumn("__qs", strip_filer_suffixes(F.col("__q")))
    f = filers.withColumn("__f", F.lower(filer)).withColumn("__fs", strip_filer_suffixes(F.col("__f")))

    texts = lambda df, plain, bare: df.select(F.explode(F.array(
        F.struct(F.lit(1).alias("tier"), F.col(plain).alias("x")), F.struct(F.lit(2).alias("tier"), F.col(plain).alias("x")),
        F.struct(F.lit(3).alias("tier"), F.col(bare).alias("x")))).alias("e")).select("e.*").distinct()
    ls, rs = texts(q, "__q", "__qs").withColumnRenamed("x", "l"), texts(f, "__f", "__fs").withColumnRenamed("x", "r")
    loose_l, loose_r = ls.where(F.col("tier") > 1), rs.where(F.col("tier") > 1)
    # tier 1 pairs a text with itself; the join with the filers' texts below keeps the existing ones
    pairs = ls.where(F.col("tier") == 1).select("tier", "l", F.col("l").alias("r"))
    pairs = pairs.unionByName(containment_join(loose_l, loose_r, "l", "r", on=("tier",))).unionByName(
        containment_join(loose_r, loose_l, "r", "l", on=("tier",)).select("tier", "l", "r"))
    # the first filer of each text is found before pairing with names, so copies meet once
    best = F.min(F.struct(F.col(order), F.col(filer)))
    lead = f.groupBy(F.col("__f").alias("r")).agg(best.alias("best")).withColumn("bare", F.lit(False)).unionByName(
        f.groupBy(F.col("__fs").alias("r")).agg(best.alias("best")).withColumn("bare", F.lit(True)))
    found = pairs.withColumn("bare", F.col("tier") == 3).join(lead, ["r", "bare"]).groupBy("tier", "l").agg(F.min("best").alias("best"))
    keyed = q.select(name, F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("__q").alias("l")), F.struct(F.lit(2).alias("tier"), F.col("__q").alias("l")),
                                             F.struct(F.lit(3).alias("tier"), F.col("__qs").alias("l")))).alias("e")).select(name, "e.*")
    hits = keyed.join(found, ["tier", "l"]).select(name, "tier", F.col(f"best.{filer}").alias(filer), F.col(f"best.{order}").alias(order))
    return first_per_key(hits, [name], [F.asc("tier"), F.asc(order)])
