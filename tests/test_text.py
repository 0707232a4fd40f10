import re

from pyspark.sql import functions as F

from factweave.functions import text as tx
from factweave.operators import labels, persons, relations
from factweave.plans.flow import parse_stages


def one(spark, col, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(col.alias("x")).first()["x"]


def test_strip_takes_the_white_space_class_off_the_ends(spark):
    every = [chr(i) for i in range(0x3100) if re.match(r"[\s\x1c-\x1f\x85]", chr(i))]
    texts = [f"{c}a{c}b{c}{c}" for c in every] + ["", " \n", "\u180ea", "\u200b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    by_class = F.regexp_replace("t", f"^{tx.WS}+|{tx.WS}+$", "")
    rows = df.select("t", tx.strip(F.col("t")).alias("got"), by_class.alias("want")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]
    assert [r["got"] for r in rows[:len(every)]] == [t.strip() for t in texts[:len(every)]]
    assert "regexp_replace" not in df.select(tx.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_count_matches_the_plain_rule(spark):
    texts = ["", "One.", "Short. This one is long enough! And so is this other one?", "<b>tagged words here</b>. x", "no marks at all but long",
             "  spaced   out   text  .      . another long piece", "twelve chars."]
    want = [max(1, len([p for p in re.split(r"[.!?]+", re.sub(r"<[^>]+>", "", t)) if len(p.strip()) > 10])) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i")
    assert [r["n"] for r in df.select(tx.sentence_count(F.col("t")).alias("n")).collect()] == want


def test_citation_forms(spark):
    df = spark.createDataFrame([("T", ["A"], 2024, 5), ("T", ["A", "B"], None, None), (None, ["A", "B", "C"], 0, None), ("", [], None, None)],
                               "t string, a array<string>, y int, p int").coalesce(1)
    got = [r["c"] for r in df.select(tx.citation(F.col("t"), F.col("a"), F.col("y"), F.col("p")).alias("c")).collect()]
    assert got == ["T - A - 2024 - p. 5", "T - A & B", "A et al.", None]


def test_sentiment_examples(spark):
    for text, want in [("announced great results", "positive"), ("company lost market share", "negative"), ("company is based in Seattle", "neutral"), ("", "neutral")]:
        assert one(spark, labels.sentiment(F.col("t"))["label"], t=text) == want


def test_sentiment_word_edges_are_unicode_aware(spark):
    assert one(spark, labels.sentiment(F.col("t"))["confidence"], t="éwon lostñ") == 0.5


def test_role_and_org_patterns(spark):
    text = "Tim Cook, CEO of Apple, announced the new iPhone."
    assert one(spark, persons.role_from_text(F.col("t")), t=text) == "CEO"
    assert one(spark, persons.org_from_text(F.col("n"), F.col("t")), n="Tim Cook", t=text) == "Apple"


def test_captcha_and_types(spark):
    assert one(spark, tx.is_captcha(F.col("t")), t="<html>Checking your browser by CloudFlare</html>") is True
    assert one(spark, tx.is_captcha(F.col("t")), t="x" * 50001 + "captcha") is False
    none = F.lit(None).cast("string")
    assert one(spark, tx.content_type(none, F.col("t")), t="http://a/b.PDF?x=.html") == "pdf"
    assert one(spark, tx.content_type(F.col("t"), F.lit("http://a")), t="text/plain") == "html"


def test_titles_and_tags(spark):
    assert one(spark, tx.clean_title(F.col("t")), t=" Article Title | Site Name ") == "Article Title"
    assert one(spark, tx.clean_title(F.col("t")), t="Co-op news") == "Co"
    assert one(spark, tx.strip_page_tags(F.col("t")), t="Biden Administration</page>") == "Biden Administration"
    assert one(spark, tx.strip_page_tags(F.col("t")), t="Secretary of Energy, PAGE)") == "Secretary of Energy)"
    assert one(spark, tx.strip_page_tags(F.col("t")), t=" None ") == ""


def test_org_suffixes_stack_in_list_order(spark):
    assert one(spark, tx.normalize_org(F.col("t")), t="Acme Co. Inc.") == "acme"
    assert one(spark, tx.normalize_org(F.col("t")), t="Acme Inc. Co.") == "acme inc."


def test_person_titles(spark):
    assert one(spark, tx.normalize_person(F.col("t")), t="Dr.  Ada   Lovelace") == "ada lovelace"


def test_stage_strings():
    assert parse_stages("1,2,3") == parse_stages("1-3") == {1, 2, 3}
    assert parse_stages("1-6") == {1, 2, 3, 4, 5}


def test_relation_json_shapes(spark):
    cases = {
        '["a", "b"]': ("a", "b", 0.5), '["a", {"text": "b"}, 0.9]': ("a", "b", 0.9), '["a", "b", 0]': ("a", "b", 0.5),
        '{"head": {"text": "a", "score": 0.4}, "tail": {"name": "b", "prob": 0.6}}': ("a", "b", 0.4),
        '{"source": "a", "target": "b", "confidence": 0.7}': ("a", "b", 0.7), '{"subject": {"span": "a"}, "object": "b"}': ("a", "b", 0.5)}
    for j, want in cases.items():
        r = one(spark, relations.parse_relation(F.col("j")), j=j)
        assert (r["head"], r["tail"], r["confidence"]) == want, j


def test_relation_json_is_built_once(spark):
    df = spark.range(1).select(F.concat_ws("#", F.lit("["), F.col("id")).alias("j")).select(relations.parse_relation(F.col("j")).alias("r")).select("r.head", "r.tail", "r.confidence")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1


def test_a_text_is_classified_once_below_a_condition(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def label(texts):
        seen.add(len(texts))
        return texts.map(lambda t: [t])

    df = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 4).cast("string").alias("t"))
    out = relations.classify_distinct(df, "t", lambda c: F.struct(label(c).alias("label"), F.lit(1.0).alias("confidence")))
    assert out.select("id", F.explode("label")).count() == 400
    assert seen.value == 4


def test_sentence_span_covers_the_sentence(spark):
    text = "First sentence. Apple announced iPhone. Last sentence."
    from factweave.operators.scoring import evidence_span
    r = one(spark, evidence_span(F.col("t"), F.lit(None).cast("string"), F.lit("apple"), F.lit("IPHONE")), t=text)
    assert text[r["start"]:r["end"]] == " Apple announced iPhone."
    assert one(spark, evidence_span(F.col("t"), F.lit(None).cast("string"), F.lit("Apple"), F.lit("Nokia")), t=text) is None


def test_nested_qualifiers_and_regions(spark):
    from factweave.operators import export
    rows = [
        ('{"identifiers": {"lei": "L", "a": "inner", "x": 1}, "a": "outer", "role": "CEO</page>", "org": "NONE"}', {"role": "CEO", "id.lei": "L", "id.a": "outer"}, None),
        ('{"identifiers": "text", "region": "", "country": "C"}', {"country": "C"}, None), ('{"region": null, "country": " C "}', {"country": "C"}, "C"), ('{"region": 5, "country": "C"}', {"country": "C"}, None),
        ("{}", None, None), ("[1]", None, None), ("no json", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = {r["i"]: (r["m"], r["region"]) for r in df.select("i", export.variant_qualifiers(F.col("v")).alias("m"), export.region_of(F.col("v")).alias("region")).collect()}
    assert got == {i: (m, region) for i, (_, m, region) in enumerate(rows)}
