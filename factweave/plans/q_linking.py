"""Catalogue: mentions, organisation and person linking, qualifiers and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import linking, persons, routing
from .derived import WS, sql_low, sql_strip, statements, statements_sql
from .registry import query
from .sql import similarity_sql

ST = statements_sql()
SIM = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 9)"
KNN_SQL = f"""kn AS (SELECT q.vec_id AS q, r.vec_id AS r, {SIM} AS similarity FROM embeddings q, embeddings r WHERE {SIM} >= 0.3),
  kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY similarity DESC, r) AS INTEGER) AS rank FROM kn), top AS (SELECT * FROM kr WHERE rank <= 20)"""
MENTION_SQL = f"""mn AS (SELECT seq, 'subject' AS side, subject AS mention, subject_type AS mention_type FROM st UNION ALL SELECT seq, 'object', object, object_type FROM st)"""


@query("mentions", f"WITH {ST}, {MENTION_SQL} SELECT seq, side, mention, mention_type, sha256(seq || chr(1) || side) AS entity_ref, {sql_low('mention')} AS lookup_key FROM mn")
def mentions(t):
    return linking.mentions(statements(t), "seq")


@query("distinct_lookups", f"WITH {ST}, {MENTION_SQL} SELECT {sql_low('mention')} AS lookup_key, mention_type, min(mention) AS mention, count(*) AS mentions FROM mn GROUP BY 1, 2")
def distinct_lookups(t):
    return linking.distinct_lookups(linking.mentions(statements(t), "seq"))


def _knn(t):
    e = t.embeddings
    return linking.knn_candidates(e.select(F.col("vec_id").alias("q"), "embedding"), e.select(F.col("vec_id").alias("r"), "embedding"), "q", "r")


@query("org_candidates", f"WITH {KNN_SQL} SELECT q, r, rank, round(similarity, 4) AS similarity FROM top")
def org_candidates(t):
    return _knn(t).select("q", "r", "rank", F.round("similarity", 4).alias("similarity"))


@query("org_accepted", f"WITH {KNN_SQL} SELECT q, r, round(similarity, 4) AS similarity FROM top WHERE rank = 2 AND similarity >= 0.4")
def org_accepted(t):
    """Every vector's nearest other vector (its second candidate), accepted above a threshold."""
    others = _knn(t).where(F.col("rank") > 1).withColumn("rank", F.col("rank") - 1)
    return linking.accept_top(others, threshold=0.4).select("q", "r", F.round("similarity", 4).alias("similarity"))


_ANSWER = "CASE q % 5 WHEN 0 THEN '1' WHEN 1 THEN 'NONE' WHEN 2 THEN ' 2 ' WHEN 3 THEN '99' ELSE 'the first' END"


@query("arbitrated_matches", f"WITH {KNN_SQL} SELECT q, rank, r, round(similarity, 4) AS similarity FROM top WHERE (q % 5 = 0 AND rank = 1) OR (q % 5 = 2 AND rank = 2)")
def arbitrated_matches(t):
    answers = t.embeddings.select(F.col("vec_id").alias("q")).withColumn("answer", F.expr(_ANSWER))
    return linking.arbitrate(_knn(t), answers, "q").select("q", "rank", "r", F.round("similarity", 4).alias("similarity"))


_SRC = "CASE s_suppkey % 5 WHEN 0 THEN 'gleif' WHEN 1 THEN 'sec_edgar' WHEN 2 THEN 'companies_house' WHEN 3 THEN 'wikidata' ELSE 'other' END"
_REGION = "CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN '' ELSE n_name END"
_PREFIX = "CASE src WHEN 'gleif' THEN 'LEI' WHEN 'sec_edgar' THEN 'SEC-CIK' WHEN 'companies_house' THEN 'UK-CH' WHEN 'wikidata' THEN 'WIKIDATA' ELSE upper(src) END"


@query("org_names", f"""WITH x AS (SELECT s_suppkey, s_name, {_SRC} AS src, {_REGION} AS region, CAST(s_suppkey + 1000 AS VARCHAR) AS sid, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || s_suppkey ELSE '' END AS tk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  y AS (SELECT *, {_PREFIX} AS p FROM x) SELECT s_suppkey, s_name || ' (' || concat_ws(',', p, nullif(region, '')) || ')' AS fqn, p || ':' || sid AS canonical_id, CASE WHEN src = 'gleif' THEN sid END AS lei,
    CASE WHEN src = 'sec_edgar' THEN sid END AS sec_cik, CASE WHEN src = 'companies_house' THEN sid END AS ch_number, CASE WHEN src = 'sec_edgar' THEN nullif(tk, '') END AS ticker FROM y""")
def org_names(t):
    c = F.col
    x = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).withColumns({
        "src": F.expr(_SRC), "region": F.expr(_REGION), "sid": (c("s_suppkey") + 1000).cast("string"),
        "tk": F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("T"), c("s_suppkey"))).otherwise("")})
    x = x.withColumn("ids", linking.org_identifiers(c("src"), c("sid"), c("tk")))
    get = lambda k: F.try_element_at("ids", F.lit(k)).alias(k)
    return x.select("s_suppkey", linking.org_fqn(c("s_name"), c("src"), c("region")).alias("fqn"), *[get(k) for k in ("canonical_id", "lei", "sec_cik", "ch_number", "ticker")])


@query("context_snippets", f"""WITH x AS (SELECT doc_id, text, length(text) // 2 AS s, CASE WHEN doc_id % 10 = 0 THEN length(text) + 5 ELSE least(length(text), length(text) // 2 + 6) END AS e FROM documents),
  y AS (SELECT *, greatest(0, s - 200) AS lo, least(length(text), e + 200) AS hi FROM x),
  z AS (SELECT *, regexp_extract(substr(text, lo + 1, s - lo), '([^.!?\\n]*)\\z', 1) AS lk, regexp_extract(substr(text, e + 1, hi - e), '^([^.!?\\n]*[.!?\\n]?)', 1) AS rk FROM y)
  SELECT doc_id, CASE WHEN e > length(text) OR s >= e THEN substr(text, 1, 400) ELSE {sql_strip('lk || substr(text, s + 1, e - s) || rk')} END AS snippet FROM z""")
def context_snippets(t):
    n = F.length("text")
    start = F.floor(n / 2).cast("int")
    end = F.when(F.col("doc_id") % 10 == 0, n + 5).otherwise(F.least(n, start + 6))
    d = t.documents.withColumns({"s": start, "e": end})
    return d.select("doc_id", tx.context_snippet(F.col("text"), F.col("s"), F.col("e")).alias("snippet"))


# ---- persons ---------------------------------------------------------------------------------

_CTX = """CASE c_custkey % 5 WHEN 0 THEN c_name || ', CEO of Acme Widgets Inc, spoke.' WHEN 1 THEN c_name || ' works at Blue River Company'
  WHEN 2 THEN 'Delta Tools ' || c_name || ' left; a vice president followed.' WHEN 3 THEN 'The chief risk officer met ' || c_name ELSE 'nothing here 123 ' || c_name || '.' END"""


@query("person_context", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'CEO' WHEN 2 THEN 'president' WHEN 3 THEN 'chief risk officer' END AS role,
  CASE c_custkey % 5 WHEN 0 THEN 'Acme Widgets Inc' WHEN 1 THEN 'Blue River Company' WHEN 2 THEN 'Delta Tools' WHEN 3 THEN 'The chief risk officer met' END AS org FROM customer""")
def person_context(t):
    x = t.customer.withColumn("ctx", F.expr(_CTX))
    return x.select("c_custkey", persons.role_from_text(F.col("ctx")).alias("role"), persons.org_from_text(F.col("c_name"), F.col("ctx")).alias("org"))


@query("role_answers", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'CEO' END AS role, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS org FROM customer""")
def role_answers(t):
    c = F.col
    name = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("NAME: "), "c_name", F.lit("\n"))).when(c("c_custkey") % 3 == 1, F.concat(F.lit("  "), "c_name", F.lit("\n"))).otherwise("")
    ans = F.concat(name, F.lit("ROLE: "), F.when(c("c_custkey") % 2 == 0, "CEO").otherwise("none"), F.lit("\n ORG:"),
                   F.when(c("c_custkey") % 4 > 0, c("c_mktsegment")).otherwise("NONE"), F.lit(" \n"))
    return t.customer.withColumn("a", persons.parse_role_answer(ans)).select("c_custkey", "a.name", "a.role", "a.org")


def _chain(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '')"
    return x


def _re(s: str) -> str:
    return s.replace(".", "\\.")


def sql_person(x: str) -> str:
    return f"trim(regexp_replace({_chain(sql_low(x), ['^' + _re(p) for p in fixed.PERSON_TITLES])}, '{WS}+', ' ', 'g'))"


def sql_org(x: str) -> str:
    return sql_strip(_chain(sql_low(x), [_re(p) + "\\z" for p in fixed.ORG_SUFFIXES]))


_PAIRS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_custkey, round(0.3 + l_discount * 5, 4) AS similarity,
  CASE WHEN l_tax > 0.04 THEN 'Mr. ' ELSE '' END || c_name AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'Dr.  ' || upper(c_name) ELSE s_name END AS known_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'CEO' WHEN 'MACHINERY' THEN 'Founder' WHEN 'HOUSEHOLD' THEN 'sales director' WHEN 'FURNITURE' THEN '' ELSE NULL END AS role,
  CASE s_nationkey % 4 WHEN 0 THEN 'Chief Executive' WHEN 1 THEN 'co-founder' WHEN 2 THEN 'Director' ELSE NULL END AS known_role,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE n_name || ' Trading Co. Inc.' END AS org,
  CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE n_name || CASE s_nationkey % 2 WHEN 0 THEN ' trading' ELSE ' Mills Ltd' END END AS known_org
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def _pairs(t):
    for n in ("lineitem", "orders", "customer", "supplier", "nation"):
        getattr(t, n).createOrReplaceTempView(f"__pairs_{n}")
    sql = _PAIRS
    for n in ("lineitem", "orders", "customer", "supplier", "nation"):
        sql = sql.replace(f"FROM {n} ", f"FROM __pairs_{n} ").replace(f"JOIN {n} ", f"JOIN __pairs_{n} ")
    return t.spark.sql(sql)


_GROUPS = [", ".join(f"'{v}'" for v in g) for g in fixed.ROLE_SYNONYMS]


def sql_role_match(a: str, b: str) -> str:
    x, y = sql_low(a), sql_low(b)
    groups = " OR ".join(f"({x} IN ({g}) AND {y} IN ({g}))" for g in _GROUPS)
    return f"({x} = {y} OR {groups} OR contains({y}, {x}) OR contains({x}, {y}))"


@query("role_org_matches", f"""WITH x AS ({_PAIRS}) SELECT DISTINCT role, known_role, org, known_org, {sql_role_match('role', 'known_role')} AS role_hit,
  ({sql_org('org')} = {sql_org('known_org')} OR contains({sql_org('org')}, {sql_org('known_org')}) OR contains({sql_org('known_org')}, {sql_org('org')})) AS org_hit FROM x""")
def role_org_matches(t):
    c = F.col
    x = _pairs(t).select("role", "known_role", "org", "known_org").distinct()
    return x.withColumns({"role_hit": tx.role_matches(c("role"), c("known_role")), "org_hit": tx.org_matches(c("org"), c("known_org"))})


@query("person_names", f"WITH x AS ({_PAIRS}) SELECT DISTINCT known_name, {sql_person('known_name')} AS person_norm, {sql_org('org')} AS org_norm FROM x")
def person_names(t):
    x = _pairs(t).select("known_name", "org").distinct()
    return x.select("known_name", tx.normalize_person(F.col("known_name")).alias("person_norm"), tx.normalize_org(F.col("org")).alias("org_norm")).distinct()


PERSON_SQL = f"""x0 AS ({_PAIRS}), x AS (SELECT * FROM x0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY similarity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, name) <= 30), n AS (SELECT *, {sql_person('name')} AS n1, {sql_person('known_name')} AS n2, {sql_org('org')} AS o1, {sql_org('known_org')} AS o2 FROM x),
  h AS (SELECT *, coalesce(coalesce(org, '') <> '' AND (o1 = o2 OR contains(o1, o2) OR contains(o2, o1)), false) AS org_hit FROM n),
  b AS (SELECT *, least(1.0, round(similarity + CASE WHEN n1 = n2 THEN 0.25 ELSE 0 END
    + CASE WHEN coalesce(role, '') <> '' AND coalesce(known_role, '') <> '' AND {sql_role_match('role', 'known_role')} THEN 0.1 ELSE 0 END
    + CASE WHEN coalesce(known_org, '') <> '' AND org_hit THEN 0.15 ELSE 0 END, 9)) AS boosted FROM h),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY boosted DESC, org_hit DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, similarity DESC, name) AS INTEGER) AS rank FROM b WHERE boosted >= 0.5)"""


def _ranked(t):
    order = [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.desc("similarity"), F.asc("name")]
    return persons.rank_candidates(_pairs(t), "c_custkey", order)


@query("person_candidates", f"WITH {PERSON_SQL} SELECT c_custkey, rank, l_orderkey, l_linenumber, l_suppkey, round(similarity, 4) AS similarity, round(boosted, 4) AS boosted FROM rk")
def person_candidates(t):
    return _ranked(t).select("c_custkey", "rank", "l_orderkey", "l_linenumber", "l_suppkey", F.round("similarity", 4).alias("similarity"), F.round("boosted", 4).alias("boosted"))


@query("person_entities", f"""WITH {PERSON_SQL}, a AS (SELECT c_custkey AS k, name AS text, role, org, known_role, known_org, known_name, boosted FROM rk WHERE rank = 1 AND boosted >= 0.85),
  f AS (SELECT k, text, known_name AS canonical_name, CASE WHEN coalesce(role, '') = '' AND coalesce(known_role, '') <> '' THEN known_role ELSE role END AS final_role,
    CASE WHEN coalesce(role, '') = '' AND coalesce(known_role, '') <> '' THEN coalesce(nullif(org, ''), nullif(known_org, '')) ELSE org END AS final_org, boosted FROM a)
  SELECT k AS c_custkey, final_role, final_org, known_name_fqn AS fqn, round(boosted, 4) AS match_confidence FROM (SELECT *, concat_ws(' ', canonical_name, '(' || nullif(final_role, '') || ')', 'at ' || nullif(final_org, '')) AS known_name_fqn FROM f)""")
def person_entities(t):
    """Best boosted candidate at or above the acceptance threshold, merged and named."""
    a = linking.accept_top(_ranked(t), "boosted").withColumn("canonical_name", F.col("known_name"))
    f = persons.fill_from_record(a)
    return f.select("c_custkey", "final_role", "final_org", persons.person_fqn(
        F.col("name"), F.col("canonical_name"), F.col("final_role"), F.col("final_org"), F.lit(None).cast("string")).alias("fqn"),
        F.round(linking.clamp01(F.col("boosted")), 4).alias("match_confidence"))


@query("unmatched_person_names", """SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (CEO)' WHEN 2 THEN ' (' || c_mktsegment || ')' ELSE ' (CEO, ' || c_mktsegment || ')' END AS fqn,
  concat_ws(' | ', c_name, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'CEO' END, CASE WHEN c_custkey % 4 >= 2 THEN c_mktsegment END) AS query_text FROM customer""")
def unmatched_person_names(t):
    k = F.col("c_custkey") % 4
    role, org = F.when(k.isin(1, 3), "CEO").otherwise(""), F.when(k >= 2, F.col("c_mktsegment"))
    none = F.lit(None).cast("string")
    return t.customer.select("c_custkey", persons.person_fqn(F.col("c_name"), none, role, org, none).alias("fqn"), persons.query_text(F.col("c_name"), role, org).alias("query_text"))


# ---- qualifiers ------------------------------------------------------------------------------

_QUAL = """SELECT c_custkey, c_name, CASE c_custkey % 3 WHEN 0 THEN 'CEO' WHEN 1 THEN '' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'ceo' WHEN 1 THEN c_mktsegment END AS org,
  CASE c_custkey % 5 WHEN 0 THEN 'TCK' WHEN 1 THEN lower(c_mktsegment) END AS ticker, CASE c_custkey % 2 WHEN 0 THEN n_name ELSE '' END AS jurisdiction, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
QUAL_SQL = _QUAL.format(customer="customer", nation="nation")


def _quals(t):
    t.customer.createOrReplaceTempView("__q_customer")
    t.nation.createOrReplaceTempView("__q_nation")
    return t.spark.sql(_QUAL.format(customer="__q_customer", nation="__q_nation"))


@query("default_names", f"""WITH x AS ({QUAL_SQL}), y AS (SELECT *, list_filter([role, org, ticker, CASE WHEN coalesce(org, '') = '' THEN jurisdiction END], lambda v: coalesce(v, '') <> '') AS p FROM x),
  z AS (SELECT *, list_transform(p, lambda v: lower(v)) AS lp FROM y), w AS (SELECT *, list_filter(p, lambda v, i: list_position(lp, lower(v)) = i) AS u FROM z)
  SELECT c_custkey, c_name || CASE WHEN len(u) > 0 THEN ' (' || array_to_string(u, ', ') || ')' ELSE '' END AS fqn FROM w""")
def default_names(t):
    c = F.col
    return _quals(t).select("c_custkey", linking.default_fqn(c("c_name"), c("role"), c("org"), c("ticker"), c("jurisdiction")).alias("fqn"))


def _qual_struct(role, org, region, country, jurisdiction, ids):
    none = F.lit(None).cast("string")
    return F.struct(none.alias("legal_name"), org.alias("org"), role.alias("role"), region.alias("region"), country.alias("country"), none.alias("city"),
                    jurisdiction.alias("jurisdiction"), ids.alias("identifiers"))


@query("merged_qualifiers", f"""WITH x AS ({QUAL_SQL}) SELECT c_custkey, coalesce(nullif(org, ''), role) AS role, coalesce(nullif(ticker, ''), org) AS org, n_name AS region, coalesce(nullif(jurisdiction, ''), n_name) AS country,
  'b' || c_custkey AS id_lei, coalesce(ticker, 'none') AS id_ticker, 'b' AS id_other, true AS any_set FROM x""")
def merged_qualifiers(t):
    c, none = F.col, F.lit(None).cast("string")
    a = _qual_struct(c("role"), c("org"), c("n_name"), c("n_name"), none, F.create_map(F.lit("lei"), F.lit("a"), F.lit("ticker"), F.coalesce("ticker", F.lit("none"))))
    b = _qual_struct(c("org"), c("ticker"), none, c("jurisdiction"), none, F.create_map(F.lit("lei"), F.concat(F.lit("b"), c("c_custkey")), F.lit("other"), F.lit("b")))
    m = _quals(t).select("c_custkey", a.alias("a"), b.alias("b")).withColumn("m", linking.merge_qualifiers(c("a"), c("b")))
    get = lambda k: F.try_element_at("m.identifiers", F.lit(k)).alias(f"id_{k}")
    return m.select("c_custkey", "m.role", "m.org", "m.region", "m.country", get("lei"), get("ticker"), get("other"), linking.has_any_qualifier(c("m")).alias("any_set"))


@query("qualifier_dicts", f"""WITH x AS ({QUAL_SQL}) SELECT c_custkey, coalesce(nullif(jurisdiction, ''), nullif(org, '')) AS region, ticker AS source, CASE WHEN coalesce(nullif(jurisdiction, ''), nullif(org, '')) IS NULL AND ticker IS NULL THEN true ELSE false END AS is_empty,
  (coalesce(role, '') <> '' OR coalesce(org, '') <> '' OR jurisdiction <> '' OR ticker IS NOT NULL) AS any_set FROM x""")
def qualifier_dicts(t):
    c, none = F.col, F.lit(None).cast("string")
    ids = F.map_filter(F.create_map(F.lit("source"), c("ticker")), lambda _, v: v.isNotNull())
    q = _quals(t).select("c_custkey", _qual_struct(c("role"), none, none, c("org"), c("jurisdiction"), ids).alias("q")).withColumn("d", linking.qualifier_dict(c("q")))
    return q.select("c_custkey", F.try_element_at("d", F.lit("region")).alias("region"), F.try_element_at("d", F.lit("source")).alias("source"),
                    c("d").isNull().alias("is_empty"), linking.has_any_qualifier(c("q")).alias("any_set"))


def canonicals(t):
    """Canonical organisations: suppliers of even key; canonical products: part names of large parts."""
    orgs = t.supplier.where(F.col("s_suppkey") % 2 == 0).select(
        tx.lower_strip(F.col("s_name")).alias("lookup_key"), F.concat(F.lit("LEI:"), "s_suppkey").alias("canonical_id"), F.upper("s_name").alias("canonical_name"),
        F.concat(F.upper("s_name"), F.lit(" (LEI)")).alias("fqn"), F.lit(0.9).alias("match_confidence"))
    parts = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.max("p_size").alias("size")).where(F.col("k") % 3 > 0).select(
        tx.lower_strip(F.col("p_name")).alias("lookup_key"), F.concat(F.lit("P:"), "k").alias("canonical_id"), F.col("p_name").alias("canonical_name"),
        F.col("p_name").alias("fqn"), F.lit(0.8).alias("match_confidence"))
    return orgs, parts


CANON_SQL = f"""co AS (SELECT {sql_low('s_name')} AS lookup_key, 'LEI:' || s_suppkey AS canonical_id, upper(s_name) AS canonical_name, upper(s_name) || ' (LEI)' AS fqn, CAST(0.9 AS DOUBLE) AS match_confidence FROM supplier WHERE s_suppkey % 2 = 0),
  cp AS (SELECT {sql_low('p_name')} AS lookup_key, 'P:' || min(p_partkey) AS canonical_id, p_name AS canonical_name, p_name AS fqn, CAST(0.8 AS DOUBLE) AS match_confidence FROM part GROUP BY p_name HAVING min(p_partkey) % 3 > 0),
  ca AS (SELECT * FROM co UNION ALL SELECT * FROM cp)"""


@query("canonical_fallback", f"""WITH {ST}, {MENTION_SQL}, {CANON_SQL} SELECT seq, side, mention, canonical_id, canonical_id IS NOT NULL AS matched, coalesce(canonical_name, mention) AS canonical_name, coalesce(fqn, mention) AS fqn
  FROM mn LEFT JOIN ca ON lookup_key = {sql_low('mention')}""")
def canonical_fallback(t):
    orgs, parts = canonicals(t)
    found = linking.first_result([(5, orgs), (10, parts)], "lookup_key").drop("priority")
    return linking.with_fallback(linking.mentions(statements(t), "seq"), found, "lookup_key").select(
        "seq", "side", "mention", "canonical_id", "matched", "canonical_name", "fqn")


@query("plugin_priority", f"""WITH {CANON_SQL}, al AS (SELECT lookup_key, canonical_id, 5 AS priority FROM co UNION ALL SELECT {sql_low('s_name')}, 'X:' || s_suppkey, 10 FROM supplier),
  r AS (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY priority) AS rn FROM al) SELECT lookup_key, canonical_id, CAST(priority AS INTEGER) AS priority FROM r WHERE rn = 1""")
def plugin_priority(t):
    orgs, _ = canonicals(t)
    other = t.supplier.select(tx.lower_strip(F.col("s_name")).alias("lookup_key"), F.concat(F.lit("X:"), "s_suppkey").alias("canonical_id"))
    return linking.first_result([(5, orgs.select("lookup_key", "canonical_id")), (10, other)], "lookup_key").select("lookup_key", "canonical_id", "priority")


_NAME = "s_name || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' Inc' WHEN 2 THEN ' Corp. Group' ELSE ' llc' END"
_FILER = "CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name || ' corp' ELSE 'the ' || s_name || ' co.' END"


def _sfx(x: str) -> str:
    for s in fixed.FILER_SUFFIXES:
        x = f"replace({x}, '{s}', '')"
    return sql_strip(x)


@query("filer_matches", f"""WITH n AS (SELECT DISTINCT {_NAME} AS name FROM supplier), q AS (SELECT name, {sql_low('name')} AS q FROM n), q2 AS (SELECT *, {_sfx('q')} AS qs FROM q),
  f AS (SELECT {_FILER} AS filer, s_suppkey AS ord, lower({_FILER}) AS f FROM supplier), f2 AS (SELECT *, {_sfx('f')} AS fs FROM f),
  h AS (SELECT name, 1 AS tier, filer, ord FROM q2 JOIN f2 ON q = f UNION ALL SELECT name, 2, filer, ord FROM q2, f2 WHERE contains(f, q) OR contains(q, f) UNION ALL SELECT name, 3, filer, ord FROM q2, f2 WHERE contains(fs, qs) OR contains(qs, fs)),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, ord) AS rn FROM h) SELECT name, CAST(tier AS INTEGER) AS tier, filer FROM r WHERE rn = 1""")
def filer_matches(t):
    names = t.supplier.select(F.expr(_NAME).alias("name"))
    filers = t.supplier.select(F.expr(_FILER).alias("filer"), F.col("s_suppkey").alias("ord"))
    return linking.filer_match(names, filers, "name", "filer", "ord").select("name", "tier", "filer")


# ---- typed linking ---------------------------------------------------------------------------

# One statement of each customer: a person (or an untyped name) and a supplier, a nation or a thing, in a sentence that may
# give the person's role and organisation.
_SUBJECT = "CASE c_custkey % 4 WHEN 0 THEN 'Mr. ' || c_name ELSE c_name END"
_TYPED = f"""SELECT c_custkey AS stmt_id, {_SUBJECT} AS subject, CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' ELSE 'PERSON' END AS subject_type,
  CASE c_custkey % 3 WHEN 0 THEN s_name WHEN 1 THEN ' ' || lower(n_name) ELSE 'Widget ' || c_custkey END AS object,
  CASE c_custkey % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'GPE' ELSE 'PRODUCT' END AS object_type,
  CASE c_custkey % 5 WHEN 0 THEN {_SUBJECT} || ', CEO of Acme Widgets Inc, spoke.' WHEN 1 THEN {_SUBJECT} || ' works at Blue River Company' WHEN 2 THEN 'nothing here 123 ' || {_SUBJECT} || '.'
    WHEN 3 THEN 'the chief risk officer met ' || {_SUBJECT} ELSE NULL END AS source_text
  FROM {{customer}} JOIN {{supplier}} ON s_suppkey = c_custkey % 10 + 1 JOIN {{nation}} ON n_nationkey = c_nationkey"""
_PEOPLE = """SELECT c_custkey AS person_id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'Chief Executive' WHEN 1 THEN 'President' END AS role,
  CASE WHEN c_custkey % 2 = 0 THEN 'Acme Widgets' END AS org FROM {customer} WHERE c_custkey % 11 > 0"""


def _low_query(name: str, role: str, org: str) -> str:
    return sql_low(f"concat_ws(' | ', {name}, nullif({role}, ''), nullif({org}, ''))")


TYPED_SQL = f"""st AS ({_TYPED.format(customer="customer", supplier="supplier", nation="nation")}), pp AS ({_PEOPLE.format(customer="customer")}),
  mn AS (SELECT stmt_id, 'subject' AS side, subject AS mention, subject_type AS mention_type FROM st UNION ALL SELECT stmt_id, 'object', object, object_type FROM st),
  mx AS (SELECT *, {sql_low('mention')} AS lookup_key, CASE WHEN mention_type = 'PERSON' THEN CASE stmt_id % 5 WHEN 0 THEN 'CEO' WHEN 3 THEN 'chief risk officer' END END AS role,
    CASE WHEN mention_type = 'PERSON' THEN CASE stmt_id % 5 WHEN 0 THEN 'Acme Widgets Inc' WHEN 1 THEN 'Blue River Company' END END AS org FROM mn),
  pq AS (SELECT DISTINCT mention AS name, role, org, {_low_query('mention', 'role', 'org')} AS qt FROM mx WHERE mention_type = 'PERSON'),
  pr AS (SELECT person_id, name AS known_name, role AS known_role, org AS known_org, {_low_query('name', 'role', 'org')} AS rt FROM pp),
  oq AS (SELECT DISTINCT lookup_key FROM mx WHERE mention_type IN ('ORG', 'UNKNOWN')), orr AS (SELECT s_suppkey, s_name, {sql_low('s_name')} AS rt FROM supplier),
  {{sims}},
  pk AS (SELECT pq.*, pr.*, round(s, 9) AS similarity FROM pq, pr JOIN psim ON a = qt AND b = rt QUALIFY row_number() OVER (PARTITION BY qt, name ORDER BY round(s, 9) DESC, person_id) <= 30),
  pn AS (SELECT *, {sql_person('name')} AS n1, {sql_person('known_name')} AS n2, {sql_org('org')} AS o1, {sql_org('known_org')} AS o2 FROM pk),
  ph AS (SELECT *, coalesce(coalesce(org, '') <> '' AND (o1 = o2 OR contains(o1, o2) OR contains(o2, o1)), false) AS org_hit FROM pn),
  pb AS (SELECT *, least(1.0, round(similarity + CASE WHEN n1 = n2 THEN 0.25 ELSE 0 END + CASE WHEN coalesce(role, '') <> '' AND coalesce(known_role, '') <> '' AND {sql_role_match('role', 'known_role')} THEN 0.1 ELSE 0 END
    + CASE WHEN coalesce(known_org, '') <> '' AND org_hit THEN 0.15 ELSE 0 END, 9)) AS boosted FROM ph),
  p1 AS (SELECT * FROM pb WHERE boosted >= 0.5 QUALIFY row_number() OVER (PARTITION BY qt, name ORDER BY boosted DESC, org_hit DESC, person_id) = 1),
  pf AS (SELECT name, role, org, known_name, person_id, boosted, CASE WHEN coalesce(role, '') = '' AND coalesce(known_role, '') <> '' THEN known_role ELSE role END AS fr,
    CASE WHEN coalesce(role, '') = '' AND coalesce(known_role, '') <> '' THEN coalesce(nullif(org, ''), nullif(known_org, '')) ELSE org END AS fo FROM p1 WHERE boosted >= 0.85),
  o1 AS (SELECT lookup_key, s_suppkey, s_name, round(s, 9) AS s FROM oq, orr JOIN osim ON a = lookup_key AND b = rt WHERE round(s, 9) >= 0.85
    QUALIFY row_number() OVER (PARTITION BY lookup_key ORDER BY round(s, 9) DESC, s_suppkey) = 1),
  g1 AS (SELECT {sql_low('n_name')} AS lookup_key, n_nationkey, n_name FROM nation)"""


@query("typed_links", "WITH " + TYPED_SQL.replace("{sims}", similarity_sql("SELECT qt AS a, rt AS b FROM pq, pr", "psim") + ",\n  " + similarity_sql("SELECT lookup_key AS a, rt AS b FROM oq, orr", "osim")) + """
  SELECT stmt_id, side, mention_type, coalesce('PERSON:' || person_id, 'LEI:' || s_suppkey, 'GEO:' || n_nationkey) AS canonical_id, coalesce(known_name, s_name, n_name, mention) AS canonical_name,
    CASE WHEN person_id IS NOT NULL THEN concat_ws(' ', known_name, '(' || nullif(fr, '') || ')', 'at ' || nullif(fo, '')) WHEN s_suppkey IS NOT NULL THEN s_name || ' (LEI)' ELSE coalesce(n_name, mention) END AS fqn,
    round(coalesce(boosted, s, CASE WHEN n_nationkey IS NOT NULL THEN 1.0 END), 4) AS match_confidence,
    CASE WHEN person_id IS NOT NULL THEN 'person' WHEN s_suppkey IS NOT NULL THEN 'organisation' WHEN n_nationkey IS NOT NULL THEN 'location' END AS linker
  FROM mx LEFT JOIN pf ON mention_type = 'PERSON' AND pf.name = mention AND pf.role IS NOT DISTINCT FROM mx.role AND pf.org IS NOT DISTINCT FROM mx.org
  LEFT JOIN o1 ON mention_type IN ('ORG', 'UNKNOWN') AND o1.lookup_key = mx.lookup_key LEFT JOIN g1 ON mention_type = 'GPE' AND g1.lookup_key = mx.lookup_key""")
def typed_links(t):
    """Mentions linked by type: persons among people, organisations and untyped names among suppliers, places among nations."""
    bind = lambda sql: sql.replace("{customer}", "{c}").replace("{supplier}", "{s}").replace("{nation}", "{n}")
    st = t.spark.sql(bind(_TYPED.replace("{{", "{").replace("}}", "}")), c=t.customer, s=t.supplier, n=t.nation)
    people = t.spark.sql(bind(_PEOPLE), c=t.customer)
    mention_rows, lookups = routing.typed_lookups(st, "stmt_id")
    found = routing.cascade(lookups, [
        routing.organisation_linker(t.supplier, "s_suppkey", "s_name"), routing.person_linker(people, "person_id", "name", "role", "org"),
        routing.name_linker(t.nation, "n_nationkey", "n_name", "GEO", frozenset({"GPE", "LOC"}), "location")])
    out = routing.linked_mentions(mention_rows, found)
    return out.select("stmt_id", "side", "mention_type", "canonical_id", "canonical_name", "fqn", F.round("match_confidence", 4).alias("match_confidence"), "linker")
