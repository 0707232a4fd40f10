import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import similarity
from factweave.operators.containment import candidate_pairs, containment_join
from factweave.operators.ranges import page_at_char, page_offsets, pages_in_range
from factweave.operators.ranking import dense_number, prefix_sum, top_per_key


def vectors(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) + 2 * rng.integers(0, 2, size=(n, 1)) * np.ones((1, dim))
    v[0] = v[1]  # a tie
    return v.astype(np.float32)


def brute(q, r, k, lo, qk=None, rk=None):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(q.astype(float)) @ unit(r.astype(float)).T, 9)
    out = set()
    for i in range(len(q)):
        ok = [(-sims[i, j], j) for j in range(len(r)) if sims[i, j] >= lo and (qk is None or qk[i] == rk[j])]
        out |= {(i, j) for _, j in sorted(ok)[:k]}
    return out


@pytest.mark.parametrize("k,lo,leaf", [(5, 0.3, 20), (None, 0.9, 20), (3, -1.0, 40), (4, 0.0, 5000)])
def test_similarity_join_is_exact(spark, monkeypatch, k, lo, leaf):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 37)
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(similarity, "LEAF", leaf)
    q, r = vectors(150, seed=1), vectors(400, seed=2)
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<float>")
    rd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "r long, w array<float>")
    got = {(x["q"], x["r"]) for x in similarity.similarity_join(qd, rd, "q", "v", "r", "w", k, lo).collect()}
    assert got == brute(q, r, k, lo)


def test_similarity_join_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [2.0, 0.0]), (4, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    join = lambda a, b, k, lo: sorted(map(tuple, similarity.similarity_join(a.select(F.col("i").alias("q"), "v"), b.select(F.col("i").alias("r"), F.col("v").alias("w")), "q", "v", "r", "w", k, lo).select("q", "r", "similarity").collect()))
    assert join(df, df, 1, -1.0) == [(0, 0, 1.0), (1, 0, 0.0), (3, 0, 1.0), (4, 4, 1.0)]
    assert join(df, df, None, 0.5) == [(0, 0, 1.0), (0, 3, 1.0), (3, 0, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    assert join(df, df.limit(0), 2, -1.0) == [] == join(df.limit(0), df, 2, -1.0)


@pytest.mark.parametrize("lo,k,share", [(0.3, 20, 0.1), (0.3, None, 0.6), (0.5, None, 0.2), (0.85, None, 0.05), (0.85, 20, 0.05)])
def test_similarity_join_prunes_clustered_vectors(lo, k, share):
    """Leaves that are visited, of all pairs of a query and a leaf, on vectors that lie in clusters."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32))
    x = similarity._unit(centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32)))
    tree = similarity.BallTree(x[:3000], 120)
    leaf, far, _, top_far = tree.place(x)
    tree.fill([(i, far[leaf == i].min(), far[leaf == i].max(), top_far[leaf == i].min(), top_far[leaf == i].max()) for i in np.unique(leaf)])
    q = x[:400]
    sims = q @ x.T
    floor, first = np.full(400, lo), 0
    if k:
        r, c = tree.visits(q, floor, leaf[:400], 0, 1)
        first = len(r)
        for i in range(400):
            mine = np.sort(sims[i, np.isin(leaf, c[r == i])])
            floor[i] = max(lo, mine[-k]) if len(mine) >= k else lo
    r, c = tree.visits(q, floor, leaf[:400], 1 if k else 0, None)
    seen = (first + len(r)) / (400 * len(tree.leaf))
    assert seen < share
    visited = np.zeros((400, len(tree.leaf)), bool)
    visited[r, c] = True
    if k:
        visited[np.arange(400), leaf[:400]] = True
    wanted = sims >= (floor[:, None] if k else lo)
    assert visited[np.nonzero(wanted)[0], leaf[np.nonzero(wanted)[1]]].all()


def test_similarity_join_within_keys(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "LEAF", 25)
    q, r = vectors(80, seed=3), vectors(200, seed=4)
    qk, rk = [i % 3 for i in range(80)], [0 if i % 3 else i % 4 for i in range(200)]  # one hot key
    qd = spark.createDataFrame([(i, qk[i], v.tolist()) for i, v in enumerate(q)], "q long, g int, v array<float>")
    rd = spark.createDataFrame([(i, rk[i], v.tolist()) for i, v in enumerate(r)], "r long, g int, w array<float>")
    got = {(x["q"], x["r"]) for x in similarity.similarity_join(qd, rd, "q", "v", "r", "w", 4, 0.2, on=("g",)).collect()}
    assert got == brute(q, r, 4, 0.2, qk, rk)


@pytest.mark.parametrize("k", [3, None])
def test_similarity_join_moves_copies_and_visits_once(spark, monkeypatch, k):
    """Copies of a vector are asked and kept once; ties between copies and between other equal similarities go to the smaller id."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(similarity, "LEAF", 10)
    monkeypatch.setattr(similarity, "VISIT_ROWS", 7)
    q, r = np.repeat(vectors(40, seed=6), 5, axis=0), np.tile(vectors(60, seed=7), (8, 1))
    placed = []
    fit = similarity.fit_tree
    monkeypatch.setattr(similarity, "fit_tree", lambda refs, *a: placed.append(refs.count()) or fit(refs, *a))
    qd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, v array<float>")
    rd = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "r long, w array<float>")
    got = {(x["q"], x["r"]) for x in similarity.similarity_join(qd, rd, "q", "v", "r", "w", k, 0.2).collect()}
    assert got == brute(q, r, k, 0.2)
    assert placed == [59 if k else 480]  # two of the 60 are equal already


def test_similarity_join_moves_a_query_once_a_group(spark, monkeypatch):
    """Leaves that share a block get a query's vector once, and matches without k are not moved again."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "LEAF", 20)
    visits = []
    kept = similarity.checkpointed
    monkeypatch.setattr(similarity, "checkpointed", lambda df: (lambda out: visits.append(out.count()) or out if "leaves" in out.columns else out)(kept(df)))
    x = vectors(320, dim=32, seed=9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, v array<float>")
    refs = df.withColumnsRenamed({"q": "r", "v": "w"})
    got = {(r["q"], r["r"]) for r in similarity.similarity_join(df, refs, "q", "v", "r", "w", 3, -1.0, steps=(None,)).collect()}
    assert got == brute(x, x, 3, -1.0)
    assert visits and sum(visits) <= 2 * 320  # 16 leaves
    assert "SortMergeJoin" not in similarity.similarity_join(df, refs, "q", "v", "r", "w", None, 0.5)._jdf.queryExecution().sparkPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_similarity_join_keeps_a_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "i long, v array<double>")
    got = similarity.similarity_join(df.withColumnsRenamed({"i": "q"}), df.withColumnsRenamed({"i": "r", "v": "w"}), "q", "v", "r", "w", 2, 0.5)
    assert {(x["q"], x["r"], x["rank"]) for x in got.collect()} == {(None, None, 1), (None, 1, 2), (1, None, 1), (1, 1, 2), (2, 2, 1)}


def test_containment_join_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    needles = [(rnd.randint(0, 2), word(rnd.randint(1, 6))) for _ in range(120)]
    hay = [(rnd.randint(0, 2), word(rnd.randint(1, 40))) for _ in range(150)]
    nd, hd = spark.createDataFrame(needles, "d int, n string"), spark.createDataFrame(hay, "d int, h string")
    got = {(r["d"], r["n"], r["h"]) for r in containment_join(nd, hd, "n", "h", on=("d",)).collect()}
    assert got == {(d, n, h) for d, n in needles for e, h in hay if d == e and n in h}
    free = {(r["n"], r["h"]) for r in containment_join(nd, hd, "n", "h").collect()}
    assert free == {(n, h) for _, n in needles for _, h in hay if n in h}


def test_pages(spark):
    pages = page_offsets(spark.createDataFrame([(1, 1, "First page"), (1, 2, "x" * 9000), (1, 3, "Short.")], "doc_id int, page_number int, text string"))
    rows = {r["page_number"]: (r["char_offset"], r["char_end"]) for r in pages.collect()}
    assert rows == {1: (0, 10), 2: (11, 9011), 3: (9012, 9018)}
    pts = spark.createDataFrame([(1, p) for p in (0, 9, 10, 11, 5000, 9010, 9011, 9012, 9018, 99999)], "doc_id int, char_pos long")
    got = {r["char_pos"]: r["page_number"] for r in page_at_char(pts, pages).collect()}
    assert got == {0: 1, 9: 1, 10: None, 11: 2, 5000: 2, 9010: 2, 9011: None, 9012: 3, 9018: 3, 99999: 3}
    rng = spark.createDataFrame([(1, 0, 11), (1, 5, 9013), (1, 9011, 9012), (1, 10, 12)], "doc_id int, start_char long, end_char long")
    hit = {}
    for r in pages_in_range(rng, pages).collect():
        hit.setdefault((r["start_char"], r["end_char"]), set()).add(r["page_number"])
    assert hit == {(0, 11): {1}, (5, 9013): {1, 2, 3}, (10, 12): {2}}


def test_prefix_sum_over_blocks(spark):
    rows = [(k, i, (i * 7) % 11) for k in ("a", "b") for i in range(100)]
    got = {(r["k"], r["i"]): r["s"] for r in prefix_sum(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], "i", F.col("v"), "s", block=8).collect()}
    assert got == {(k, i): sum((j * 7) % 11 for j in range(i)) for k in ("a", "b") for i in range(100)}


def test_dense_number(spark):
    rows = [(f"name {i % 1000:04d}",) for i in random.Random(1).sample(range(1000), 1000)]
    got = [(r["name"], r["n"]) for r in dense_number(spark.createDataFrame(rows, "name string"), ["name"], "n").orderBy("name").collect()]
    assert got == [(f"name {i:04d}", i + 1) for i in range(1000)]


def test_top_per_key_ranks_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_per_key(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_candidates_of_numbered_names_grow_with_the_names(spark):
    """Any three digits stand in a fixed share of all numbered names; wider grams do not."""
    for n in (1000, 4000):
        names = [f"supplier#{i:09d}" for i in range(n)]
        needles = spark.createDataFrame([(x,) for x in names], "n string")
        hay = spark.createDataFrame([(f"the {x} co.",) for x in names], "h string")
        assert candidate_pairs(needles, hay, "n", "h")[0].count() < 4 * n
        assert containment_join(needles, hay, "n", "h").count() == n


def test_containment_of_long_and_odd_needles(spark):
    """Needles around the widths' edges, with letters outside the basic plane, inside, at the ends of and longer than the haystacks."""
    base = "aXéb\U0001F600cde fghij klm\U0001F600\U0001F600nop qrs tuv abcabcabcabcabc"
    needles = {base[a: a + n] for n in (1, 2, 3, 5, 6, 7, 11, 12, 13, 20, len(base)) for a in (0, 4, 9, 17)} | {"abcabc", "abcabcabcabc", base + "z", "nothere", "not in here at all"}
    hay = {base, base[5:30], base[10:], "abcabcabc", "a", "z" + base[:13]}
    needles.discard("")
    got = containment_join(spark.createDataFrame([(x,) for x in needles], "n string"), spark.createDataFrame([(x,) for x in hay], "h string"), "n", "h").collect()
    assert {(r["n"], r["h"]) for r in got} == {(x, y) for x in needles for y in hay if x in y} and len(got) == len(set(got))
