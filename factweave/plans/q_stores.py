"""Catalogue: result cache, run log, feedback, location dimension and vector backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import embed
from ..operators import candidates, countries, locations
from ..sources import stores
from .derived import sql_low, sql_strip, statements, statements_sql
from .q_statements import STMT_SQL
from .registry import query

ST = statements_sql()


def _cache(t):
    return t.events.select(F.concat(F.lit("u"), "user_id").alias("input_hash"), F.col("ts").alias("created_at"), "event_id", F.col("value").cast("int").alias("n_statements"))


CACHE_SQL = "ch AS (SELECT 'u' || user_id AS input_hash, ts AS created_at, event_id, CAST(trunc(value) AS INTEGER) AS n_statements FROM events), nw AS (SELECT max(ts) AS now FROM events)"


def _now(t):
    """The newest timestamp of the log stands for the clock; a one-row table, joined to every row."""
    return t.events.agg(F.max("ts").alias("now"))


@query("cache_lookup", f"""WITH {CACHE_SQL}, live AS (SELECT ch.* FROM ch, nw WHERE created_at >= now - INTERVAL 24 HOUR), r AS (SELECT *, row_number() OVER (PARTITION BY input_hash ORDER BY created_at DESC, event_id DESC) AS rn FROM live)
  SELECT q.input_hash, r.event_id, r.created_at, r.n_statements FROM (SELECT DISTINCT 'u' || user_id AS input_hash FROM events) q LEFT JOIN r ON r.input_hash = q.input_hash AND rn = 1""")
def cache_lookup(t):
    now = F.lit(_now(t).first()["now"])
    cache = _cache(t)
    return stores.cache_lookup(cache.select("input_hash").distinct(), cache, now).select("input_hash", "event_id", "created_at", "n_statements")


@query("cache_upsert", f"""WITH {CACHE_SQL}, old AS (SELECT *, 0 AS fresh FROM ch WHERE event_id % 2 = 0), new AS (SELECT *, 1 AS fresh FROM ch WHERE event_id % 2 = 1 AND n_statements > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY input_hash ORDER BY fresh DESC, created_at DESC, event_id DESC) AS rn FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) SELECT input_hash, created_at, event_id, n_statements FROM r WHERE rn = 1""")
def cache_upsert(t):
    """Odd events arrive as fresh results on top of the even ones; empty results are not stored."""
    c = _cache(t)
    odd = F.col("event_id") % 2 == 1
    return stores.cache_upsert(c.where(~odd), c.where(odd)).select("input_hash", "created_at", "event_id", "n_statements")


@query("cache_cleanup", f"WITH {CACHE_SQL} SELECT input_hash, created_at, event_id FROM ch, nw WHERE created_at >= now - INTERVAL 24 HOUR")
def cache_cleanup(t):
    return stores.cache_cleanup(_cache(t), F.lit(_now(t).first()["now"])).select("input_hash", "created_at", "event_id")


@query("cache_keys", "SELECT doc_id, sha256(text || ':canonical=' || CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END) AS input_hash FROM documents")
def cache_keys(t):
    return t.documents.select("doc_id", stores.cache_key(F.col("text"), F.col("lang") == "en").alias("input_hash"))


RUN_SQL = "rl AS (SELECT user_id AS run_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM events)"


def _runs(t):
    state = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "running").when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    return t.events.select(F.col("user_id").alias("run_id"), "ts", "event_id", state.alias("status"))


@query("latest_runs", f"""WITH {RUN_SQL} SELECT run_id, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) FILTER (status IN ('succeeded', 'failed')) AS completed_at, count(*) AS updates FROM rl GROUP BY 1""")
def latest_runs(t):
    return stores.latest_runs(_runs(t), "run_id", ["ts", "event_id"])


@query("first_failures", f"WITH {RUN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS rn FROM rl WHERE status = 'failed') SELECT run_id, ts, event_id FROM r WHERE rn = 1")
def first_failures(t):
    return stores.run_error(_runs(t), "run_id", [F.asc("ts"), F.asc("event_id")]).select("run_id", "ts", "event_id")


@query("feedback_rows", f"""WITH {ST} SELECT '<page>' || source_text || '</page>' AS input_text, '<statements>' || {STMT_SQL} || '</statements>' AS output_xml, CAST(1 AS INTEGER) AS num_statements,
  CAST(NULL AS BOOLEAN) AS accepted, CASE beam WHEN 0 THEN 'upload' WHEN 1 THEN 'liked' ELSE 'correction' END AS source FROM st""")
def feedback_rows(t):
    one = candidates.statement_xml(*[F.col(c) for c in ("subject", "subject_type", "predicate", "object", "object_type", "source_text")])
    df = statements(t).withColumns({"output_xml": F.concat(F.lit("<statements>"), one, F.lit("</statements>")), "num_statements": F.lit(1),
                                    "source": F.when(F.col("beam") == 0, "upload").when(F.col("beam") == 1, "liked").otherwise("spam")})
    return stores.feedback_rows(df).select("input_text", "output_xml", "num_statements", "accepted", "source")


@query("training_lines", f"""WITH {ST} SELECT seq, CASE WHEN beam < 3 THEN source_text END AS input_text, CASE WHEN beam < 3 THEN '<stmt>' || subject || '</stmt>' END AS output_xml,
  CASE WHEN beam < 3 THEN CAST(CASE WHEN beam = 1 THEN 0 ELSE 2 END AS INTEGER) END AS num_statements, CASE WHEN beam < 3 THEN true END AS accepted, beam = 3 AS is_broken FROM st""")
def training_lines(t):
    """Training data as JSON lines, some without a count and some cut off."""
    df = statements(t)
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    count = F.when(F.col("beam") != 1, ', "num_statements": 2').otherwise("")
    whole = F.concat(F.lit('{"input": '), q(F.col("source_text")), F.lit(', "output": '), q(F.concat(F.lit("<stmt>"), "subject", F.lit("</stmt>"))), count, F.lit("}"))
    lines = df.select("seq", F.when(F.col("beam") == 3, F.regexp_replace(whole, "}$", "")).otherwise(whole).alias("value"))
    keyed = stores.training_lines(lines, keep=["seq"])
    return keyed.select("seq", "input_text", "output_xml", "num_statements", "accepted", F.col("broken").isNotNull().alias("is_broken"))


# ---- locations -------------------------------------------------------------------------------

def _labels(t):
    """Label table: part names with a qid per part; many parts share a name, the first key wins."""
    return t.part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("label"), F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_partkey").alias("ord"))


@query("label_index", f"SELECT {sql_low('p_name')} AS name_normalized, 'Q' || min(p_partkey) AS qid FROM part GROUP BY 1")
def label_index(t):
    return locations.label_index(_labels(t), "label", "qid", "ord")


def _names(t):
    orgs = t.part.select(F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.initcap("p_name")).alias("region"))
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.lit("  ")).alias("country"))
    return locations.location_names([(orgs, "region"), (people, "country")])


_INIT = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
NAMES_SQL = f"""ln AS (SELECT DISTINCT {sql_strip('x')} AS name FROM (SELECT CASE WHEN p_size % 7 = 0 THEN ' ' ELSE {_INIT} END AS x FROM part UNION SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE {sql_strip('x')} <> ''),
  li AS (SELECT {sql_low('p_name')} AS nn, min(p_partkey) AS qid FROM part GROUP BY 1),
  ld AS (SELECT name, lower(name) AS name_normalized, qid, CASE WHEN qid IS NULL THEN 'pycountry' ELSE 'wikidata' END AS source, row_number() OVER (ORDER BY name) AS location_id FROM ln LEFT JOIN li ON nn = lower(name))"""


@query("location_names", f"WITH {NAMES_SQL} SELECT name FROM ln")
def location_names(t):
    return _names(t)


def _dim(t):
    return locations.location_dimension(_names(t), locations.label_index(_labels(t), "label", "qid", "ord"))


@query("location_dimension", f"WITH {NAMES_SQL} SELECT name, name_normalized, qid, source, location_id FROM ld")
def location_dimension(t):
    return _dim(t).select("name", "name_normalized", "qid", "source", "location_id")


@query("region_keys", f"""WITH {NAMES_SQL}, o AS (SELECT p_partkey, {_INIT} AS region, CASE p_size % 4 WHEN 0 THEN 'gleif' WHEN 1 THEN 'sec_edgar' WHEN 2 THEN 'wikidata' ELSE 'x' END AS src FROM part)
  SELECT p_partkey, location_id AS region_id, CAST(CASE src WHEN 'gleif' THEN 1 WHEN 'sec_edgar' THEN 2 ELSE 4 END AS INTEGER) AS source_number FROM o LEFT JOIN ld ON ld.name = o.region""")
def region_keys(t):
    k = F.col("p_size") % 4
    facts = t.part.select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" ")).alias("region"),
                          F.when(k == 0, "gleif").when(k == 1, "sec_edgar").when(k == 2, "wikidata").otherwise("x").alias("source"))
    return locations.assign_region(facts, "region", _dim(t)).select("p_partkey", "region_id", "source_number")


def _countries(t):
    """Nations with made-up codes: two letters of the key, the three-letter code adds an X."""
    two = F.concat(F.chr((F.floor(F.col("n_nationkey") / 26) + 65).cast("long")), F.chr((F.col("n_nationkey") % 26 + 65).cast("long")))
    return t.nation.select(two.alias("alpha_2"), F.concat(two, F.lit("X")).alias("alpha_3"), F.col("n_name").alias("country_name"))


COUNTRY_SQL = "cc AS (SELECT n_name AS country_name, lower(n_name) AS cname, chr(65 + n_nationkey // 26) || chr(65 + n_nationkey % 26) AS alpha_2, chr(65 + n_nationkey // 26) || chr(65 + n_nationkey % 26) || 'X' AS alpha_3 FROM nation)"


def country_sql(names: str) -> str:
    """Every name of the table `names` against every country."""
    return f"""{COUNTRY_SQL}, ck AS (SELECT DISTINCT name, {sql_low('name')} AS k FROM {names}),
  cd AS (SELECT *, CASE WHEN k = lower(alpha_2) THEN -2 WHEN k = lower(alpha_3) THEN -1 ELSE levenshtein(k, cname) END AS d FROM ck, cc WHERE k <> ''),
  cr AS (SELECT name, alpha_2, alpha_3, country_name, CAST(greatest(d, 0) AS INTEGER) AS distance FROM cd WHERE d <= least(2, length(k) // 4) QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, cname, alpha_2) = 1)"""


@query("country_codes", f"""WITH raw AS (SELECT CASE s_suppkey % 8 WHEN 0 THEN n_name WHEN 1 THEN '  ' || lower(n_name) || ' ' WHEN 2 THEN substr(n_name, 1, 3) || substr(n_name, 5) WHEN 3 THEN substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3)
    WHEN 4 THEN replace(n_name, 'A', 'E') || 'X' WHEN 5 THEN chr(65 + n_nationkey // 26) || chr(65 + n_nationkey % 26) WHEN 6 THEN lower(chr(65 + n_nationkey // 26) || chr(65 + n_nationkey % 26) || 'X') ELSE s_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  {country_sql('raw')} SELECT ck.name, alpha_2, alpha_3, country_name, distance FROM ck LEFT JOIN cr ON cr.name = ck.name""")
def country_codes(t):
    """Suppliers' nations as written, in other case, with a letter missing, two swapped, two wrong, as codes, and names of no nation."""
    known = _countries(t)
    x = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(known, F.col("n_name") == F.col("country_name"))
    n, k = F.col("n_name"), F.col("s_suppkey") % 8
    rest = lambda at: F.substring(n, at, 100)
    name = (F.when(k == 0, n).when(k == 1, F.concat(F.lit("  "), F.lower(n), F.lit(" "))).when(k == 2, F.concat(F.substring(n, 1, 3), rest(5)))
            .when(k == 3, F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), rest(3))).when(k == 4, F.concat(F.replace(n, F.lit("A"), F.lit("E")), F.lit("X")))
            .when(k == 5, F.col("alpha_2")).when(k == 6, F.lower("alpha_3")).otherwise(F.col("s_name")))
    return countries.resolve_countries(x.select(name.alias("name")), "name", known)


@query("location_codes", f"""WITH {NAMES_SQL}, {country_sql('ld')} SELECT ld.name, location_id, qid, source, alpha_2, alpha_3 FROM ld LEFT JOIN cr ON cr.name = ld.name""")
def location_codes(t):
    """The location dimension with the country codes of its names."""
    names = _names(t)
    codes = countries.resolve_countries(names, "name", _countries(t)).where(F.col("alpha_2").isNotNull())
    codes = codes.select(F.lower("name").alias("name_normalized"), "alpha_2", "alpha_3").distinct()
    dim = locations.location_dimension(names, locations.label_index(_labels(t), "label", "qid", "ord"), codes)
    return dim.select("name", "location_id", "qid", "source", "alpha_2", "alpha_3")


PAR_SQL = f"""{NAMES_SQL}, rec AS (SELECT p_partkey, ['Q' || (p_partkey % 50), 'bad', 'Q' || (p_partkey % 7)] AS parents, ['Q' || (p_partkey % 50), 'Q' || (p_partkey % 90)] AS countries FROM part),
  w AS (SELECT p_partkey, unnest(list_concat(parents, countries)) AS q, generate_subscripts(list_concat(parents, countries), 1) AS i FROM rec), f AS (SELECT p_partkey, i, location_id FROM w LEFT JOIN ld ON ld.qid = TRY_CAST(substr(q, 2) AS BIGINT) WHERE q <> 'bad'),
  g AS (SELECT p_partkey, location_id, min(i) AS i, count(*) AS n FROM f GROUP BY ALL)"""


@query("parent_locations", f"""WITH {PAR_SQL}, p AS (SELECT p_partkey, string_agg(CAST(location_id AS VARCHAR), ',' ORDER BY i) FILTER (location_id IS NOT NULL) AS parent_ids, coalesce(sum(n) FILTER (location_id IS NULL), 0) AS unresolved FROM g GROUP BY 1)
  SELECT p_partkey, coalesce(parent_ids, '') AS parent_ids, CAST(unresolved AS BIGINT) AS unresolved, CASE WHEN parent_ids IS NULL THEN 'none' WHEN unresolved > 0 THEN 'partial' ELSE 'resolved' END AS status FROM p""")
def parent_locations(t):
    q = lambda m: F.concat(F.lit("Q"), F.col("p_partkey") % m)
    rec = t.part.select("p_partkey", F.array(q(50), F.lit("bad"), q(7)).alias("parents"), F.array(q(50), q(90)).alias("countries"))
    out = locations.resolve_parents(rec, _dim(t).where(F.col("qid").isNotNull()), "p_partkey", "parents", "countries")
    return out.select("p_partkey", F.array_join(F.col("parent_ids").cast("array<string>"), ",").alias("parent_ids"), "unresolved", "status")


@query("missing_vectors", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t):
    return locations.missing_rows(t.part.select("p_partkey"), t.embeddings.select(F.col("vec_id").alias("p_partkey")), "p_partkey")


@query("vector_backfill", "SELECT p_partkey, CASE WHEN vec_id IS NULL THEN 256 ELSE 64 END AS dims FROM part LEFT JOIN embeddings ON vec_id = p_partkey UNION ALL SELECT vec_id, 64 FROM embeddings WHERE vec_id NOT IN (SELECT p_partkey FROM part)")
def vector_backfill(t):
    done = t.embeddings.select(F.col("vec_id").alias("p_partkey"), "embedding")
    return locations.backfill(t.part, done, "p_partkey", "p_name", embed).select("p_partkey", F.size("embedding").alias("dims"))
