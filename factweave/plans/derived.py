"""Statement-shaped tables derived from the star schema, with the same derivation as SQL text.

A supplier (ORG) supplies / ships / takes back a part (PRODUCT); the document is a column of
lineitem, `seq` is a total order over its rows, 1 - 8 x discount is the confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

WS = tx.WS


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def sql_low(x: str) -> str:
    return sql_strip(f"lower({x})")


_PREDICATE = "CASE l_returnflag WHEN 'A' THEN 'supplies' WHEN 'N' THEN 'ships' ELSE 'takes back' END"


def statements(t, doc: str = "l_orderkey") -> DataFrame:
    digits = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    seq = F.concat(
        digits(F.col("l_linenumber"), 2), digits(F.col("l_partkey"), 12), digits(F.col("l_suppkey"), 12),
        digits(F.col("l_quantity"), 4), digits(F.round(F.col("l_extendedprice") * 100), 14),
        digits(F.round(F.col("l_discount") * 100), 3), digits(F.round(F.col("l_tax") * 100), 3), F.col("l_returnflag"),
        F.col("l_linestatus"), F.date_format("l_shipdate", "yyyyMMdd"), digits(F.col("l_orderkey"), 12))
    # behind the joins, so that where they shuffle the long seq does not travel
    base = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn("seq", seq)
    predicate = F.expr(_PREDICATE)
    verb = F.when(F.col("l_linestatus") == "O", predicate).otherwise(F.lit("handed over"))
    return base.select(
        F.col(doc).alias("doc_id"), "seq", F.col("s_name").alias("subject"), F.lit("ORG").alias("subject_type"),
        predicate.alias("predicate"), F.col("p_name").alias("object"),
        F.when(F.col("p_size") % 5 == 0, "UNKNOWN").otherwise("PRODUCT").alias("object_type"),
        F.concat(verb, F.lit(" "), F.col("p_name"), F.lit(".")).alias("source_text"),
        F.round(1 - 8 * F.col("l_discount"), 2).alias("confidence"),
        (F.col("l_linenumber") % 4).alias("beam"), F.floor(F.col("l_linenumber") / 4).cast("int").alias("attempt"))


def statements_sql(doc: str = "l_orderkey") -> str:
    digits = lambda c, n: f"lpad(CAST(CAST({c} AS BIGINT) AS VARCHAR), {n}, '0')"
    return f"""st AS (SELECT {doc} AS doc_id,
    {digits('l_linenumber', 2)} || {digits('l_partkey', 12)} || {digits('l_suppkey', 12)} || {digits('l_quantity', 4)}
    || {digits('round(l_extendedprice * 100)', 14)} || {digits('round(l_discount * 100)', 3)} || {digits('round(l_tax * 100)', 3)}
    || l_returnflag || l_linestatus || strftime(l_shipdate, '%Y%m%d') || {digits('l_orderkey', 12)} AS seq,
    s_name AS subject, 'ORG' AS subject_type, {_PREDICATE} AS predicate, p_name AS object,
    CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN' ELSE 'PRODUCT' END AS object_type,
    (CASE WHEN l_linestatus = 'O' THEN {_PREDICATE} ELSE 'handed over' END) || ' ' || p_name || '.' AS source_text,
    round(1 - 8 * l_discount, 2) AS confidence, l_linenumber % 4 AS beam, l_linenumber // 4 AS attempt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


PAGES_SQL = f"""pg AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text, role,
    CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
  FROM conversations)"""

SENTENCES_SQL = f"""sents AS (SELECT doc_id, lang, text, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (
    SELECT doc_id, lang, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'),
      lambda x: {sql_strip('x')}), lambda x: length(x) > 0) AS s FROM documents))"""
