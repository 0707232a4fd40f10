import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators import html, ocr
from factweave.operators.documents import join_pages
from factweave.sources import documents as src
from factweave.sources import stores

PAGE = """<html><head><title>Page Title | Site</title><meta property="og:title" content=" OG Title "><meta name="author" content="John Doe">
<meta name="description" content="About"><meta property="article:published_time" content="2024-01-01"></head><body><nav>Menu</nav>
<div class="sidebar-x">side</div><main><p>short</p></main><article><h1>Head</h1><p>{body}</p><script>var x = "</p>";</script>
<p class="navy">gone too</p>tail<br>more</article><footer>foot</footer></body></html>"""
LONG = "Long enough words to be taken as the content of the page, more than one hundred characters in total it is."


def extract(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return html.extract_pages(df).orderBy("i").collect()


def test_article_text_and_metadata(spark):
    r = extract(spark, PAGE.format(body=LONG))[0]
    assert r["text"] == f"Head\n{LONG}\ntail\nmore"
    assert (r["title"], r["meta_title"], r["author"], r["published_date"], r["description"]) == ("Page Title", "OG Title", "John Doe", "2024-01-01", "About")


def test_short_article_falls_back_to_body(spark):
    r = extract(spark, "<title>A</title><body><article>tiny</article><p>rest &amp; more</p></body>", f"<body><article>tiny</article><div id=content>{LONG}</div></body>",
                '<div>unclosed <p>one <b>two', "", '<body><span class="byline">By Ann</span><time datetime="2020">x</time></body>')
    assert [x["text"] for x in r[:4]] == ["tiny\nrest & more", LONG, "unclosed\none\ntwo", ""]
    assert (r[4]["author"], r[4]["published_date"]) == ("By Ann", "2020")


def test_references_without_semicolon(spark):
    page = '<title>a&amp;b&amp</title><body><p id="&amp;&copy=1">x &lt y &#38; z && &unknown; &lt;</p><script>a && b</script></body>'
    df = spark.createDataFrame([(page,)], "html string")
    got = lambda **kw: html.extract_pages(df, **kw).select("meta_title", "text").first()
    assert tuple(got()) == ("a&b&", "x < y & z && &unknown; <")
    assert tuple(got(open_references=False)) == ("a&b&amp", "x &lt y & z && &unknown; <")


def brute_cut(text):
    whole = text.strip()
    if not whole:
        return text
    if len(whole) > 100:
        m = re.search(r"(.{10,%d}?)\1{9,}" % (len(whole) // 10), whole, re.S)
        if m:
            return whole[: m.start()] + m.group(1)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) >= 10:
        common, n = Counter(lines).most_common(1)[0]
        if n >= 10 and n / len(lines) >= 0.8:
            for i in range(len(lines) - 2):
                if lines[i] == lines[i + 1] == lines[i + 2] == common:
                    seen = 0
                    raw = text.split("\n")
                    for j, line in enumerate(raw):
                        seen += bool(line.strip())
                        if seen == i + 1:
                            return "\n".join(raw[: j + 1])
    return text


def test_repeat_cutting_equals_the_regex():
    rnd = random.Random(2)
    cases = ["", "plain text", "ab" * 100, "x" * 99, "x" * 120, "line\n" * 12, "a\n\nb\n" + "same\n" * 40]
    for _ in range(300):
        unit = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 25)))
        head = "".join(rnd.choice("abcd\n ") for _ in range(rnd.randint(0, 60)))
        cases.append(head + unit * rnd.randint(5, 25) + head[::-1])
    for t in cases:
        assert ocr.without_loops(t) == brute_cut(t), repr(t)


def test_predicate_and_taxonomy_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("acquired\n\n# note\n  owned by \n")
    assert [r[0] for r in src.read_predicate_lines(spark, str(tmp_path / "p.txt")).collect()] == ["acquired", "owned by"]
    (tmp_path / "p.json").write_text(json.dumps({"c": {"x": {"description": "d", "threshold": 0.5}, "y": {"description": "e"}}}))
    assert sorted(tuple(r) for r in src.read_predicate_json(spark, str(tmp_path / "p.json")).collect()) == [("c", "x", "d", 0.5), ("c", "y", "e", None)]
    (tmp_path / "t.json").write_text(json.dumps({"env": {"water": {"description": "w", "id": 3}}}))
    assert src.read_taxonomy_json(spark, str(tmp_path / "t.json")).select("category", "label", "label_id").first()[:] == ("env", "water", 3)


def test_text_and_pdf_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello\nworld \n")
    assert src.read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "hello\nworld"
    (tmp_path / "b.pdf").write_bytes(b"%PDF-one|two ")
    out = src.read_pdfs(spark, str(tmp_path / "b.pdf"), lambda b: (b.decode().split("|"), {"title": "T", "author": ""}))
    assert [(r["page_number"], r["text"], r["metadata"]) for r in out.orderBy("page_number").collect()] == [(1, "%PDF-one", {"title": "T"}), (2, "two", {"title": "T"})]


def test_fetch_retries_and_keeps_errors(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("no route")
        return url, b"%PDF-1.4" if "doc" in url else b"<html>just a moment</html>", "application/octet-stream"

    df = src.fetch(spark.createDataFrame([("http://bad",), ("http://doc",), ("http://page",)], "url string"), fetcher)
    got = {r["url"]: (r["route"], r["error"]) for r in src.classify_fetched(df.where("content is not null")).collect()}
    assert got == {"http://doc": ("pdf", None), "http://page": ("html", "CAPTCHA or challenge page")}
    assert df.where("url = 'http://bad'").first()["error"] == "no route"


def test_join_pages_joins_every_document(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "x" * 50)], "doc_id int, page_number int, text string")
    got = {r["doc_id"]: r["full_text"] for r in join_pages(pages).collect()}
    assert got == {1: "a\nb", 2: "x" * 50}


def test_cache_ttl_and_upsert(spark):
    rows = [("k", "2024-01-02 00:00:00", 1, 3), ("k", "2024-01-01 23:00:00", 2, 4), ("old", "2023-12-30 00:00:00", 3, 5)]
    c = spark.createDataFrame(rows, "input_hash string, c string, id int, n_statements int").select(
        "input_hash", F.col("c").cast("timestamp").alias("created_at"), "id", "n_statements")
    now = F.lit("2024-01-02 01:00:00").cast("timestamp")
    req = spark.createDataFrame([("k",), ("old",), ("none",)], "input_hash string")
    assert {r["input_hash"]: r["id"] for r in stores.cache_lookup(req, c, now).collect()} == {"k": 1, "old": None, "none": None}
    fresh = c.where("id = 3").withColumn("n_statements", F.lit(0)).unionByName(c.where("id = 2"))
    assert {r["input_hash"]: r["id"] for r in stores.cache_upsert(c.where("id <> 2"), fresh).collect()} == {"k": 2, "old": 3}
    assert stores.cache_cleanup(c, now).count() == 2


@pytest.mark.parametrize("fields,want", [("{}", 0), ('{"lei": "x", "city": " ", "role": "NONE"}', 1)])
def test_coerced_qualifiers(spark, fields, want):
    from factweave.operators.export import coerce_qualifiers
    df = spark.createDataFrame([(fields,)], "j string").select(F.from_json("j", "map<string,string>").alias("m"))
    assert df.select(F.size(coerce_qualifiers(F.col("m"))).alias("n")).first()["n"] == want


def test_loaded_urls_and_rejects(spark):
    from factweave.sources import loading

    long = "<html><head><title>T | Site</title></head><body><p>" + "real words here " * 10 + "</p></body></html>"
    web = {
        "http://a/x.pdf": (b"%PDF-1 two\fpages", None), "http://b": (b"%PDF-2 sniffed", "application/octet-stream"), "http://c": (long.encode(), "text/html"), "http://d": (long.encode() + b"\xff\xfe", None),
        "http://e": (b"<html><body>short</body></html>", "text/html"), "http://f": (b"<html>Just a moment...</html>", "text/html"), "http://g": (b"", None), "http://h": (b"bad", "application/pdf"),
    }

    def fetcher(url):
        if url not in web:
            raise OSError("no route")
        return url + "/", *web[url]

    def parser(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return content.decode().split("\f"), {"title": "P"}

    urls = spark.createDataFrame([(u, 1) for u in [*web, "http://z", "http://c"]], "url string, error int")
    loaded = loading.load_urls(urls, fetcher, parser)
    docs = sorted((r["url"], r["source_type"], r["title"], r["page_count"]) for r in loading.documents(loaded).collect())
    assert docs == [("http://a/x.pdf", "pdf", "P", 2), ("http://b", "pdf", "P", 1), ("http://c", "webpage", "T | Site", 1), ("http://c", "webpage", "T | Site", 1), ("http://d", "webpage", "T | Site", 1)]
    bad = {r["url"]: r["reason"] for r in loading.rejected(loaded).collect()}
    assert bad == {"http://e": loading.NO_TEXT, "http://f": loading.CHALLENGE, "http://g": loading.NO_TEXT, "http://h": "Failed to parse PDF: no PDF", "http://z": "no route"}
    assert loading.load_urls(urls.limit(0), fetcher, parser).count() == 0


def test_training_lines_round_trip(spark, tmp_path):
    from factweave.sources import stores

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"input": "a\\nb", "output": "<x/>", "num_statements": 3}\n\n{"input": "é", "output": ""}\n{"input": "cut\n[1]\n{"output": "no input"}\n')
    rows = stores.read_training(spark, str(tmp_path / "in"))
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert got == sorted([("a\nb", "<x/>", 3, True, None, None), ("é", "", 0, True, None, None), (None, None, None, None, None, '{"input": "cut'), (None, None, None, None, None, "[1]"),
                          (None, None, None, None, None, '{"output": "no input"}')], key=repr)
    stores.write_training(rows, str(tmp_path / "out"))
    again = stores.read_training(spark, str(tmp_path / "out"))
    assert sorted((r["input_text"], r["num_statements"]) for r in again.collect()) == [("a\nb", 3), ("é", 0)]


def test_provenance_is_the_first_sentence_contained(spark):
    from factweave.operators import documents
    rng = random.Random(5)
    texts = lambda n: ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    sentences = [(d, i, x) for d, n in ((1, 20), (2, 300), (3, 2)) for i, x in enumerate(texts(n))] + [(2, 900, ""), (None, 0, "a")]
    sources = [(d, x * 2) for d in (1, 2, 4) for x in texts(200)] + [(2, ""), (None, "a"), (2, None)]
    want = {}
    for d, source in sources:
        hits = [(i, x) for k, i, x in sentences if k == d and d is not None and source and x and x in source]
        if hits:
            want[d, source] = min(hits)
    st, s = spark.createDataFrame(sources, "d int, source string"), spark.createDataFrame(sentences, "d int, i int, x string")
    out = documents.provenance(st, s, "d", "source", "x", "i")
    assert sorted((r["d"], r["source"], r["i"], r["x"]) for r in out.collect()) == sorted((*k, *v) for k, v in want.items())
    # a text is moved as such: nothing is exploded into its characters' grams, and no pairs are shuffled
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert documents.first_contained(["xay", "zz"], ["b", "a"]) == [1, None] == documents.first_contained(["xay", "zz"], ["b", "a", *map(str, range(100))])


def test_small_look_ups_move_no_large_side(spark, monkeypatch):
    """Whatever Spark's estimate of a derived table is; a larger one is joined with a shuffle, with the same rows."""
    from factweave.operators import export, linking
    from factweave.sources import checkpoints
    st = spark.createDataFrame([(i, f"s{i % 3}", "ORG", "supplies", f"o{i % 2}", "PRODUCT", None, None, 0.5, None, ["a"]) for i in range(8)],
                               "seq int, subject string, subject_type string, predicate string, object string, object_type string, canonical_predicate string, predicate_category string, confidence double, sentiment string, topics array<string>")
    found = st.groupBy(F.col("subject").alias("lookup_key")).agg(F.min("seq").alias("canonical_id")).where(F.col("canonical_id") > 0).selectExpr("lookup_key", "canonical_id", "lookup_key AS canonical_name", "lookup_key AS fqn")
    ends = st.select("seq", F.col("subject").alias("mention"), F.col("subject").alias("lookup_key"))
    queries = [lambda: export.cypher_edges(st, export.cypher_nodes(st)).select("seq", "line"), lambda: linking.with_fallback(ends, found, "lookup_key")]
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = [q() for q in queries]
        assert all("SortMergeJoin" not in plan(df) for df in few)
        monkeypatch.setattr(checkpoints, "FEW", 1)
        many = [q() for q in queries]
        assert all("SortMergeJoin" in plan(df) for df in many)
        assert [sorted(map(str, df.collect())) for df in few] == [sorted(map(str, df.collect())) for df in many]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_memory_of_the_line_loop_follows_the_text():
    """One long line beside many short ones: no line takes the room of the longest."""
    import tracemalloc

    text = "\n".join(f"{i} {i * 7919 % 1009}" for i in range(2000)) + "\n" + " ".join(map(str, range(20_000)))
    tracemalloc.start()
    got = ocr._line_loop(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got is None and peak < 20 * len(text)
