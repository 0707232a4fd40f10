import hashlib
import re

import pytest

from factweave.llm import catalogue, infilling


def rule(doc_id, text, seed=7, rate=100, spm=50):
    """(n, form, prefix, middle, output) by the rule itself."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def expected(rows, **how):
    out = []
    for doc_id, text in rows:
        n, form, p, m, output = rule(doc_id, text, **how)
        out.append((doc_id, n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_the_rule(spark, docs_folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()]
    got = catalogue.QUERIES["op12_fill_in_middle"](spark, docs_folder)
    assert rows_of(got) == expected(rows)
    assert {r[2] for r in expected(rows)} == {"psm", "spm"}


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'k' as key", "1 as pos", "2 as copies", "3 as n", "'f' as form")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(infilling.digests(docs)) == expected(rows)
    assert infilling.digests(no_docs).count() == 0 and infilling.transform(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 14])
def test_outputs_of_small_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(infilling, "CHUNK", chunk)
    lines = ["a\n", "\n", "éß 語\n", "no end", "x" * 40, "\r\n", "<P", ">\n", " \t\n"]
    rows = [(i, "".join(lines[(i * k) % len(lines)] for k in range(i % 13))) for i in range(60)] + [(None, "a\nb"), (None, "a\nb"), (7, "one <M> mark\n"), (8, "\n\n\n"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(infilling.digests(df, rate=70, spm_share=30)) == expected(rows, rate=70, spm=30)
    got = sorted(map(tuple, infilling.transform(df, rate=70, spm_share=30).collect()), key=repr)
    assert got == sorted([(i, *[rule(i, t, rate=70, spm=30)[j] for j in (1, 4)]) for i, t in rows], key=repr)


def test_equal_rows_are_combined_and_counted(spark):
    df = spark.range(30_000, numPartitions=3).selectExpr("cast(null as long) as doc_id", "'same\ntext\n' as text")
    few = infilling.pieces(df)
    assert few.count() <= 3 * 3 * 4  # batches x pieces
    got = infilling.digests(df).groupBy(*COLUMNS).count().collect()
    assert [r["count"] for r in got] == [30_000] and rows_of(infilling.digests(df.limit(1))) == expected([(None, "same\ntext\n")])


def test_one_shuffle(odd_docs):
    plan = infilling.digests(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(key" in plan


def test_long_units_are_cut_and_whole_ones_kept():
    text = ("ab\n" * 10 + "y" * 50 + "\n" + "cd\n" * 3).encode()
    ends = infilling.np.flatnonzero(infilling.np.frombuffer(text, "u1") == 10) + 1
    got = list(infilling.chunks(0, len(text), ends, 16))
    assert b"".join(text[a:b] for a, b in got) == text and all(b - a <= 16 for a, b in got)
    assert got[0] == (0, 15) and list(infilling.chunks(5, 5, ends, 16)) == [(5, 5)]
