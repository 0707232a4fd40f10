import random

from pyspark.sql import functions as F

from factweave.operators import countries, documents, export


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_within_two_edits_equal_brute_force(spark):
    """Few letters, so that many names are near several countries; lengths on both sides of the index's prefix."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
    known = [(f"{chr(65 + i // 26)}{chr(65 + i % 26)}", f"Z{chr(65 + i // 26)}{chr(65 + i % 26)}", word()) for i in range(60)]
    names = {word() for _ in range(80)}
    for _, _, c in known:
        for edits in (1, 2, 3):
            x = list(c)
            for _ in range(edits):
                at, kind = rng.randrange(len(x) + 1), rng.randrange(3)
                x[at:at + (kind > 0)] = [] if kind == 1 else [rng.choice("abc")]
            names.add("".join(x))
    names.add("")
    got = countries.resolve_countries(spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n", spark.createDataFrame(known, "alpha_2 string, alpha_3 string, country_name string"))
    got = {r["name"]: (r["country_name"], r["alpha_2"], r["distance"]) for r in got.collect()}
    assert set(got) == names
    for n in names:
        near = []
        for a2, a3, c in known:
            d = -2 if n == a2.lower() else -1 if n == a3.lower() else distance(n, c)
            if n and d <= min(2, len(n) // 4):
                near.append((d, c, a2))
        want = min(near) if near else None
        assert got[n] == ((want[1], want[2], max(want[0], 0)) if want else (None, None, None)), n


def test_codes_case_and_blanks(spark):
    known = spark.createDataFrame([("XA", "XAB", "Examplia"), ("XB", "XBB", "Sampleland")], "alpha_2 string, alpha_3 string, country_name string")
    names = ["xa", " XBB ", "EXAMPLIA", "exmplia", "Smaplelandd", "Sampl", "X", "  "]
    got = {r["name"]: r["alpha_2"] for r in countries.resolve_countries(spark.createDataFrame([(n,) for n in names], "n string"), "n", known).collect()}
    assert got == {"xa": "XA", " XBB ": "XB", "EXAMPLIA": "XA", "exmplia": "XA", "Smaplelandd": None, "Sampl": None, "X": None, "  ": None}


def test_contexts_merge_and_absent_parts(spark):
    logs = spark.createDataFrame([
        (1, 2, "split", 5, "error", "late"), (1, 1, "split", 7, "error", "early"), (1, 1, "link", 1, "warning", "w"), (2, 1, None, 9, None, None), (2, 2, "link", 3, None, None), (3, 1, None, None, "warning", "only"),
    ], "doc_id long, at int, stage string, s long, level string, message string")
    merged = documents.merged_logs(logs, "doc_id", "stage", "s", "level", "message", ["at"])
    got = {r["doc_id"]: (r["timings"], r["errors"], r["warnings"]) for r in merged.collect()}
    assert got == {1: ({"link": 1, "split": 12}, ["early", "late"], ["w"]), 2: ({"link": 3}, None, None), 3: (None, [], ["only"])}
    docs = spark.createDataFrame([(1, "t", None, 0), (4, None, "s", 2)], "doc_id long, title string, summary string, duplicates_removed long")
    st = spark.createDataFrame([(1, 0, "b", "x"), (1, 1, "a", "y")], "doc_id long, chunk int, seq string, subject string")
    out = {r["doc_id"]: r["context"] for r in documents.context_dict(docs, st, merged, "doc_id", "chunk", ["seq"], ["subject"]).collect()}
    assert out[1] == ('{"document_id":1,"document_title":"t","summary":null,"chunk_count":2,"statement_count":2,"duplicates_removed":0,'
                      '"statements":[{"subject":"y"},{"subject":"x"}],"timings":{"link":1,"split":12},"errors":["early","late"],"warnings":["w"]}')
    assert out[4].endswith('"chunk_count":0,"statement_count":0,"duplicates_removed":2,"statements":[],"timings":{},"errors":[],"warnings":[]}')


def test_edits_append_blank_rows(spark):
    st = spark.createDataFrame([("a", "s", "ORG", "p"), ("b", "s", "ORG", "p")], "k string, subject string, subject_type string, predicate string")
    edits = spark.createDataFrame([("a", "update", None), ("b", "delete", None), ("c", "append", None), ("d", "append", "q"), ("e", "update", "lost")], "k string, action string, new_predicate string")
    got = sorted(map(tuple, export.apply_edits(st, edits, "k").collect()))
    assert got == [("a", "s", "ORG", "p"), ("c", "", "UNKNOWN", ""), ("d", "", "UNKNOWN", "q")]
    assert export.apply_edits(st, edits.where(F.lit(False)), "k").count() == 2
