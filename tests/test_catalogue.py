"""Catalogue queries against their SQL on the smallest tables. FULL_CATALOGUE=1 runs all of them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from factweave.operators import routing
from factweave.plans.flow import FlowConfig, text_statements

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "sentence_count", "page_texts", "sentiment_by_document", "exact_dedup", "merge_beams", "coverage", "repair_candidate_xml", "triple_scores",
    "reversal_fix", "lexicon_relations", "relation_shapes", "org_candidates", "person_entities", "filer_matches", "default_names", "confidence_labels",
    "topics_hierarchical", "topics_by_text", "page_at_char", "sentence_provenance", "csv_rows", "cypher_edges", "parsed_answers", "cache_lookup",
    "location_dimension", "parent_locations", "stream_window_counts", "stream_latest_runs",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FULL_CATALOGUE") else SAMPLE


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(cur.fetchall(), [d[0] for d in cur.description])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["merge_beams", "semantic_dedup", "chunk_pages", "statements_of_documents"])
def test_results_do_not_depend_on_partitioning(spark, name):
    got = []
    for parts in ("1", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = entry.queries()[name](spark, FOLDER)
        got.append(table([tuple(r) for r in df.collect()], df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


def test_stages_can_be_switched_off(spark):
    docs = spark.createDataFrame([(1, "The box is red. Nothing here.")], "doc_id int, text string")
    orgs = spark.createDataFrame([(1, "box")], "s_suppkey long, s_name string")
    full = text_statements(docs, orgs, FlowConfig()).collect()
    assert [(r["subject"], r["predicate"], r["object"], r["subject_canonical_id"]) for r in full] == [("box", "instance_of", "red", "LEI:1")]
    only = text_statements(docs, orgs, FlowConfig(stages=frozenset({1, 2})))
    assert only.count() == 1 and "sentiment" not in only.columns
    assert text_statements(docs, orgs, FlowConfig(stages=frozenset({1}))).count() == 2
    skipped = text_statements(docs, orgs, FlowConfig(stages=frozenset({1, 2, 4}))).first()  # labels need entities: stage 3 runs all the same
    assert skipped["subject_fqn"] == "box (LEI)" and skipped["subject_canonical_id"] == "LEI:1"


def test_flow_links_by_type(spark):
    docs = spark.createDataFrame([(1, "Lee with Acme. Acme from Berlin."), (2, "Ray with Zeta!"), (3, "Lee with Berlin.")], "doc_id int, text string")
    orgs = spark.createDataFrame([(1, "Acme"), (2, "Zeta"), (3, "Lee")], "s_suppkey long, s_name string")
    people = spark.createDataFrame([(7, "Lee", "CEO", "Acme"), (8, "Ray", None, None)], "person_id long, name string, role string, org string")
    places = spark.createDataFrame([(3, "BERLIN "), (4, "berlin")], "id long, n string")
    kind = lambda text, sentence: F.when(text.isin("Lee", "Ray"), "PERSON").when(text == "Berlin", "GPE").otherwise("ORG")
    cfg = FlowConfig(typer=kind, linkers=(routing.name_linker(places, "id", "n", "GEO", frozenset({"GPE"}), "location"),))
    rows = text_statements(docs, orgs, cfg, people).orderBy("doc_id", "subject").collect()
    got = [(r["doc_id"], r["subject"], r["subject_canonical_id"], r["object"], r["object_canonical_id"]) for r in rows]
    assert got == [(1, "Acme", "LEI:1", "Berlin", "GEO:3"), (1, "Lee", None, "Acme", "LEI:1"), (2, "Ray", "PERSON:8", "Zeta", "LEI:2"), (3, "Lee", None, "Berlin", "GEO:3")]


def test_cascade_asks_each_linker_only_for_what_is_open(spark):
    look = spark.createDataFrame([("a", "x", "ORG"), ("b", "y", "ORG"), ("c", "z", "GPE"), ("d", "w", None)], "lookup_id string, lookup_key string, mention_type string")
    asked = {}

    def linker(name, priority, types, takes):
        def find(df):
            asked[name] = sorted(r["lookup_id"] for r in df.collect())
            return df.where(F.col("lookup_id").isin(takes)).select("lookup_id", F.lit(name).alias("canonical_id"), F.lit(name).alias("canonical_name"), F.lit(name).alias("fqn"), F.lit(1.0).alias("match_confidence"))
        return routing.Linker(name, priority, types, find)

    found = routing.cascade(look, [linker("late", 9, None, ["a", "b", "d"]), linker("orgs", 1, frozenset({"ORG"}), ["a"]), linker("geo", 5, frozenset({"GPE"}), [])])
    assert sorted((r["lookup_id"], r["linker"]) for r in found.collect()) == [("a", "orgs"), ("b", "late"), ("d", "late")]
    assert asked == {"orgs": ["a", "b"], "geo": ["c"], "late": ["b", "c", "d"]}


def test_plans_push_columns_down(spark):
    plan = entry.queries()["sentiment_by_document"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
