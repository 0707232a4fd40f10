import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import catalogue, common, jaccard, windows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                top[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(first.get(find(i), d), d)
    return sorted(((d, len(sets[i]), first.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, groups, size):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 30, 120]))]
        for _ in range(size):
            w = [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else f"z{rng.randrange(50)}" for x in base]
            rows.append((len(rows), " ".join(w[rng.randrange(3):])))
    return rows


@pytest.mark.parametrize("seed,groups,size", [(1, 6, 25), (2, 40, 3), (3, 1, 120)])
def test_join_equals_brute_force(spark, seed, groups, size):
    rows = near_copies(seed, groups, size)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute(rows)


def test_join_of_documents_in_small_blocks(spark, docs_folder, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, catalogue.QUERIES["op9_jaccard_join"](spark, docs_folder).collect()), key=repr)
    assert got == brute(rows)


def test_bytes_of_shared_incidences():
    """What a block hands on takes a key and a count for each n-gram; the sets' ids come once, not with each n-gram."""
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(400)]
    texts = [" ".join(pool[a: a + 300]) for a in rng.integers(0, 100, 100)]
    lay, _ = jaccard._incidence(1, np.zeros(0, np.uint64))
    count, _ = jaccard._counted(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["doc_id", "text"])
    got = count(pa.Table.from_batches(lay(iter([batch]))))
    incidences = sum(len(x) for x in got.column("keys").to_pylist()) // 6
    assert incidences > 15_000 and sum(c.nbytes for c in got.columns) < 12 * incidences


def test_join_of_odd_and_no_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, jaccard.join(odd_docs).collect()), key=repr)
    want = [(d, n, d if n == 0 else c) for d, n, c in brute(rows)]
    assert got == sorted(want, key=repr)
    assert jaccard.join(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    top = {x: x for e in edges for x in e}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def tree_nodes(v, t):
    out = set()
    for i in range(len(v)):
        a = b = i
        while a > 0 and v[a - 1] > v[i]:
            a -= 1
        while b < len(v) - 1 and v[b + 1] >= v[i]:
            b += 1
        if v[i] > 0 and b - a + 1 >= t:
            out.add((a, i, b))
    return out


@pytest.mark.parametrize("n", [0, 1, 45, 46, 47, 400])
@pytest.mark.parametrize("t", [2, 7, 46])
def test_compact_windows_equal_the_tree(n, t):
    rng = np.random.default_rng(n + t)
    for high in (5, 50, 1 << 40):
        v = rng.integers(0, high, size=n).astype(np.uint64)
        assert set(zip(*(x.tolist() for x in windows.compact_windows(v, t)))) == tree_nodes(v, t)


def test_every_shared_passage_is_found(spark, docs_folder):
    rows = spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()
    text = {r[0]: words(r[1]) for r in rows}
    where = defaultdict(set)
    for d, w in text.items():
        for k in range(len(w) - 50):
            where[tuple(w[k: k + 51])].add(d)
    want = set().union(*[s for s in where.values() if len(s) > 1])
    got = catalogue.QUERIES["op4_repeated_passages"](spark, docs_folder).collect()
    assert want <= {r["doc_id"] for r in got}
    for r in got:
        a, b = text[r["doc_id"]][r["start_word"]: r["end_word"]], text[r["first_doc_id"]][r["first_start"]: r["first_end"]]
        assert len(a) >= 50 and len(b) >= 50 and r["doc_id"] != r["first_doc_id"]
        x, y = ({tuple(w[i: i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) / len(x | y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.75


def test_planted_passages(spark):
    rng = random.Random(9)
    passage = [f"p{rng.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(100_000)}" for _ in range(150)]
        if i % 3 == 0:
            p = list(passage)
            if i % 2:
                p[rng.randrange(20, 40)] = "changed"
            own[50:50] = p
        rows.append((i, " ".join(own)))
    got = windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(0, 60, 3))
    assert {r["doc_id"] for r in got if r["keep"]} <= set(range(0, 60, 3))


def test_passages_of_odd_and_no_rows(odd_docs, no_docs):
    got = windows.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in got} == {8, 9}
    assert windows.repeated_passages(no_docs).count() == 0


def test_utf8_of_slices():
    column = pa.array(["a", None, "bé", ""]).slice(1)
    data, offsets = common.utf8(column)
    assert data[offsets[0]: offsets[-1]].tobytes().decode() == "bé" and len(offsets) == 4
