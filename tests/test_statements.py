import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factweave.functions.vectors import gram_counts, row_cosine
from factweave.operators import candidates, dedup, evidence, scoring

STMT = "doc int, seq int, subject string, subject_type string, predicate string, object string, object_type string, source_text string, confidence double"


def cos(a, b):
    return float(np.round(row_cosine(gram_counts(pd.Series([a])), gram_counts(pd.Series([b])))[0], 9))


def swap(s):
    return {**s, "subject": s["object"], "object": s["subject"], "subject_type": s["object_type"], "object_type": s["subject_type"], "was_reversed": True}


def merge(own, other):
    return {**own, **{k: other[k] for k in ("subject_type", "object_type") if own[k] == "UNKNOWN"}}


def brute_dedup(rows, threshold):
    """Every statement against every survivor so far, with all texts embedded where they are needed."""
    kept = []
    low = lambda t: t.lower().strip()

    def forms(r):
        src = low(r["source_text"] or f"{r['subject']} {r['predicate']} {r['object']}")
        return cos(low(f"{r['subject']} {r['predicate']} {r['object']}"), src), cos(low(f"{r['object']} {r['predicate']} {r['subject']}"), src)

    for r in rows:
        r = {**r, "was_reversed": False}
        fwd, rev = forms(r)
        hit = None
        for k in kept:
            s = k["stmt"]
            direct = low(s["subject"]) == low(r["subject"]) and low(s["object"]) == low(r["object"])
            turned = low(s["subject"]) == low(r["object"]) and low(s["object"]) == low(r["subject"])
            if (direct or turned) and cos(low(k["pred"]), low(r["predicate"])) >= threshold:
                hit = (k, direct)
                break
        if hit is None:
            kept.append({"stmt": r, "pred": r["predicate"], "fwd": fwd, "rev": rev, "pos": r["seq"]})
            continue
        k, direct = hit
        old = k["stmt"]
        if direct:
            if fwd > k["fwd"]:
                k.update(stmt=merge(r, old), pred=r["predicate"], fwd=fwd, rev=rev)
            else:
                k["stmt"] = merge(old, r)
        elif max(fwd, rev) > max(k["fwd"], k["rev"]):
            new = swap(r) if rev > fwd else r
            k.update(stmt=merge(new, swap(old) if k["rev"] > k["fwd"] else old), pred=r["predicate"], fwd=fwd, rev=rev)
        else:
            base = swap(old) if k["rev"] > k["fwd"] and not old["was_reversed"] else old
            k["stmt"] = merge(base, swap(r) if rev > fwd else r)
    return {(k["pos"], k["stmt"]["subject"], k["stmt"]["predicate"], k["stmt"]["object"], k["stmt"]["subject_type"], k["stmt"]["object_type"], k["stmt"]["was_reversed"]) for k in kept}


@pytest.mark.parametrize("seed", range(4))
def test_semantic_dedup_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    names, preds = ["Apple", "beats ", "Google", "apple"], ["acquired", "acquires", "bought", "was acquired by", "buys"]
    rows = []
    for i in range(120):
        if i % 5 == 0 and i < 100:
            rows += [(*rows[-1][:1], i * 100 + j, *rows[-1][2:]) for j in range(1, rnd.randint(2, 9))] if rows else []
        s, o, p = rnd.choice(names), rnd.choice(names), rnd.choice(preds)
        src = rnd.choice([None, f"{s} {p} {o}", f"{o} {rnd.choice(preds)} {s}", f"In May {s} {p} the firm {o}"])
        rows.append((i % 2, i * 100, s, rnd.choice(["ORG", "UNKNOWN"]), p, o, rnd.choice(["PRODUCT", "UNKNOWN"]), src, 0.5))
    names_ = [c.split()[0] for c in STMT.split(", ")]
    want = set()
    for d in (0, 1):
        want |= {(d, *x) for x in brute_dedup([dict(zip(names_, r)) for r in rows if r[0] == d], 0.65)}
    for parts in (1, 7, 3):
        df = spark.createDataFrame(rows, STMT).repartition(parts)
        out = dedup.semantic_dedup(df, ["doc"], "seq")
        got = {(r["doc"], r["position"], r["subject"], r["predicate"], r["object"], r["subject_type"], r["object_type"], r["was_reversed"]) for r in out.collect()}
        assert got == want


def test_redundancy(spark):
    rows = [(1, 1, "A", "x", "announced", "iPhone", "x", None, 0.5), (1, 2, "A", "x", "announced", "iPad", "x", None, 0.5),
            (2, 1, "A", "x", "announced", "iPhone", "x", None, 0.5), (2, 2, "a", "x", "Announced", "iphone", "x", None, 0.5)]
    r = {x["doc"]: x["redundancy"] for x in scoring.beam_stats(spark.createDataFrame(rows, STMT), ["doc"]).collect()}
    assert r == {1: 0.0, 2: 1.0}


def test_merge_beams_keeps_best_at_first_position(spark):
    rows = [(1, 0, 0, "A", "ORG", "announced", "X", "P", "A announced X", 0.4), (1, 0, 1, "A", "ORG", "announced", "Y", "P", "A announced Y", 0.9),
            (1, 1, 0, "a", "ORG", "announced", "x", "P", "a announced x", 0.8), (1, 1, 1, "A", "ORG", "is", "Z", "P", "A is Z", 0.9),
            (1, 1, 2, "A", "ORG", "sold", "Q", "P", "A bought Q", 0.9)]
    df = spark.createDataFrame(rows, "doc int, beam int, seq int, subject string, subject_type string, predicate string, object string, object_type string, source_text string, confidence double")
    scored = scoring.beam_score(scoring.beam_stats(df, ["doc", "beam"]))
    out = scoring.merge_beams(df, scored, ["doc"], "beam", "seq")
    got = sorted((r["subject"], r["object"], r["confidence"]) for r in out.collect())
    assert got == [("A", "Y", 0.9), ("a", "x", 0.8)]


def test_triple_without_source_is_neutral(spark):
    df = spark.createDataFrame([("a", "p", "b", "")], "s string, p string, o string, src string")
    c = F.col
    assert df.select(scoring.triple_score(c("s"), c("p"), c("o"), c("src"), F.lit(1.0), F.lit(1.0)).alias("x")).first()["x"] == 0.5


def test_both_ways_to_find_first_places(monkeypatch):
    terms = ["", "ab", "b", "bab", "zz", "語b", "a"]
    texts = ["", "abab語b", "bab" * 50]
    direct = [evidence.first_places(t, terms) for t in texts]
    monkeypatch.setattr(evidence, "DIRECT", -1)
    assert [evidence.first_places(t, terms) for t in texts] == direct == [{x: t.find(x) for x in terms if x in t} for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_and_coverage_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(evidence, "PER_ROW", 7)
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Acme", "ß", "é x", "buys", "it", "ACME corp", "語", "of", "\u2003", "\x1c", "a\nb", "end."])
    docs = [(d, "".join(word() + rnd.choice([" ", "", ". ", "! "]) for _ in range(rnd.choice([0, 3, 40, 3000])))) for d in range(12)] + [(90, None), (91, " \n ")]
    rows = [(rnd.choice(docs)[0], rnd.randint(0, 2), i, rnd.choice([None, "", word() + " " + word(), word()]), rnd.choice([word(), None, "nowhere"]), word()) for i in range(300)] + [(99, 0, 0, "x", "y", "z")]
    dd = spark.createDataFrame(docs, "doc int, text string")
    sd = spark.createDataFrame(rows, "doc int, beam int, seq int, source_text string, subject string, object string")
    text = dict(docs)

    def span(t, src, s, o):
        if t is None or not src and s is None:
            return None
        low = t.lower()
        if src and src.lower() in low:
            return low.find(src.lower()), low.find(src.lower()) + len(src)
        if s is None or s.lower() not in low or o.lower() not in low:
            return None
        a, b = low.find(s.lower()), low.find(o.lower())
        lo, hi = min(a, b), max(a + len(s), b + len(o))
        while lo > 0 and t[lo - 1] not in ".!?\n":
            lo -= 1
        while hi < len(t) and t[hi] not in ".!?\n":
            hi += 1
        return lo, hi + (hi < len(t))

    want = {(d, b, i): span(text[d], src, s, o) for d, b, i, src, s, o in rows if d in text}
    spans = evidence.evidence_spans(dd, sd, "doc", "text", ["beam", "seq"])
    got = {(r["doc"], r["beam"], r["seq"]): None if r["start"] is None else (r["start"], r["end"]) for r in spans.collect()}
    assert got == want
    cover = {(r["doc"], r["beam"]): r["coverage"] for r in evidence.coverage(spans, dd, "doc", ["beam"], "text").collect()}
    for (d, b), share in cover.items():
        t, at = text[d], set()
        for (x, y, _), s in want.items():
            if (x, y) == (d, b) and s:
                at |= set(range(*s))
        content = sum(not c.isspace() for c in t)
        assert share == pytest.approx(sum(not t[i].isspace() for i in at if i < len(t)) / content if content else 0.0), (d, b)
    assert set(cover) == {(d, b) for d, b, _ in want if text[d] is not None}


def test_short_documents_have_short_index_rows(spark):
    texts = ["", "a b", "x" * 63, "y " * 32, "z" * 100, " " * 128 + "é", "w" * 256]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    rows = evidence.content_index(df, "doc", "text", 128).collect()
    assert {(r["doc"], r["bucket"]): len(r["words"]) for r in rows} == {
        (0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 0): 2, (4, 0): 2, (5, 0): 2, (5, 1): 1, (6, 0): 2, (6, 1): 2, (6, 2): 1}
    for r in rows:
        for at in range(min(128, len(texts[r["doc"]]) - 128 * r["bucket"]) + (r["bucket"] == len(texts[r["doc"]]) // 128)):
            bits = r["words"][at // 64] & ((1 << at % 64) - 1)
            assert r["base"] + r["upto"][at // 64] + bits.bit_count() == len(texts[r["doc"]][: 128 * r["bucket"] + at].replace(" ", ""))


def test_a_text_is_embedded_once_a_chunk(monkeypatch):
    from factweave.functions import vectors
    seen = []
    monkeypatch.setattr(vectors, "gram_counts", lambda texts: seen.append(len(texts)) or gram_counts(texts))
    a, b = pd.Series(["blue bolt", "red ring", None, ""] * 1000), pd.Series(["blue ring"] * 4000)
    assert (vectors.pair_cosine(a, b) == row_cosine(gram_counts(a), gram_counts(b))).all()
    assert sum(seen) == 2 * (4 + 1)


def test_rescoring_only_where_no_confidence_is_given(spark):
    rows = [(1, 1, "A", "ORG", "buys", "B", "ORG", "A buys B", 0.0), (1, 2, "A", "ORG", "buys", "B", "ORG", "A buys B", 0.7), (1, 3, "A", "ORG", "buys", "B", "ORG", None, None), (2, 4, "A", "ORG", "buys", "B", "ORG", "", 0.0)]
    docs = spark.createDataFrame([(1, "A buys B")], "doc int, text string")
    got = {r["seq"]: r["quality"] for r in scoring.rescored(spark.createDataFrame(rows, STMT), docs, "doc", "text").collect()}
    assert got == {1: 0.6, 2: 0.7, 3: 0.6, 4: 0.5}


def test_coverage_of_overlapping_spans(spark):
    docs = spark.createDataFrame([(1, "ab cd  ef")], "doc int, text string")
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 3, 4), (1, 0, 1, 40), (1, 1, 0, 2), (1, 2, None, None)], "doc int, beam int, start int, end int")
    got = {r["beam"]: round(r["coverage"], 4) for r in evidence.coverage(spans, docs, "doc", ["beam"], "text").collect()}
    assert got == {0: 1.0, 1: round(2 / 6, 4), 2: 0.0}


XML = [
    ("<statements><stmt><subject type=\"ORG\">A & B</subject><object type=\"gpe\">C</object><predicate>p</predicate><text>t</text></stmt></statements>", [("A & B", "ORG", "C", "GPE")]),
    ("<statements><stmt><subject type=\"ORG\">A</subject><object>B < C</object><predicate>p</predicate></stmt></statements>", [("A", "ORG", "B < C", "UNKNOWN")]),
    ("<statements><stmt><subject>A</subject><object>B</object><predicate>p</predicate></stmt></statemen", [("A", "UNKNOWN", "B", "UNKNOWN")]),
    ("<statements><stmt><subject>A</subject><object>B</object></stmt><stmt><subject>C</subj", [("A", "UNKNOWN", "B", "UNKNOWN")]),
    ("<statements><stmt><subject>A</subject><object>B</object></stmt></statements> trailing & junk", [("A", "UNKNOWN", "B", "UNKNOWN")]),
    ("<other><stmt><subject>A</subject><object>B</object></stmt></other>", []),
    ("<statements></statements>", []), ("nonsense", []),
]


def test_candidate_xml_is_repaired(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(XML)], "i int, xml string")
    got = {}
    for r in candidates.parse_statements_xml(df, "xml").orderBy("i", "stmt_idx").collect():
        got.setdefault(r["i"], []).append((r["subject"], r["subject_type"], r["object"], r["object_type"]))
    assert got == {i: w for i, (_, w) in enumerate(XML) if w}


def test_repair_names(spark):
    for end, name in (("</statement", "truncated closer"), ("</statemen", "missing root closer")):
        df = spark.createDataFrame([("<statements><stmt>A & B</stmt>" + end,)], "x string")
        r = df.select(candidates.repair_xml(F.col("x")).alias("r")).first()["r"]
        assert r["repairs"] == ["ampersand", name]
        assert r["xml"] == "<statements><stmt>A &amp; B</stmt></statements>"


def test_best_per_source_keeps_rows_without_source(spark):
    rows = [(1, 1, "a", "x", "p", "b", "x", "s", 0.2), (1, 2, "a", "x", "q", "b", "x", "s", 0.9), (1, 3, "a", "x", "r", "b", "x", None, 0.1), (1, 4, "a", "x", "r", "b", "x", None, 0.1)]
    out = scoring.best_per_source(spark.createDataFrame(rows, STMT), ["doc"], [F.asc("seq")])
    assert sorted(r["seq"] for r in out.collect()) == [2, 3, 4]


def test_candidates_to_statements(spark):
    from factweave.plans.candidates_flow import ExtractionOptions, statements_from_candidates
    stmt = lambda s, p, o, src: f"<stmt><subject type='ORG'>{s}</subject><object>{o}</object><predicate>{p}</predicate><text>{src}</text></stmt>"
    wrap = lambda *x: "<statements>" + "".join(x) + "</statements>"
    text = "Apple acquired Beats in May. Google bought YouTube long ago."
    answers = [
        (1, 0, 0, wrap(stmt("Apple", "acquired", "Beats", "Apple acquired Beats in May."))),
        (1, 0, 1, wrap(stmt("apple", "acquired", "beats", "Apple acquired Beats in May."), stmt("Google", "bought", "YouTube", "Google bought YouTube long ago."))),
        (1, 1, 0, wrap(stmt("Never", "used", "Attempt", "never used Attempt"))),
    ]
    a = spark.createDataFrame(answers, "doc_id int, attempt int, beam int, xml string")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    out = statements_from_candidates(a, docs, ExtractionOptions(predicates=("acquired", "sued by"))).collect()
    got = sorted((r["subject"].lower(), r["predicate"], r["object"].lower(), r["canonical_predicate"]) for r in out)
    assert [g[:3] for g in got] == [("apple", "acquired", "beats"), ("google", "bought", "youtube")]
    assert got[0][3] == "acquired"
    single = statements_from_candidates(a, docs, ExtractionOptions(merge_beams=False, all_triples=True))
    assert single.count() == 2
