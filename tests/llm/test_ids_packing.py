import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import catalogue, common, idfiles, packing

BYTE, WORDS = (common.tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", " ", "a b", "  a  b \n\n c\n", "x , y., z", "foo) , (a), b", "é, è. 5, 6\n", "it's we'll 's", "tab\t\tx  \n y", "a\x01b, c", "\x1cq x", "é ́a", "Ünïcode 123 4567", "日本語 text, and. more", "a!, b", "<|endoftext|> x"]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_the_tokenizer(path):
    enc = common.Encoder(path)
    for text in TEXTS * 2 + ["".join(t) for t in itertools.product(["a", "B", ",", ".", " ", "\n", "1"], repeat=4)]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    enc.FULL = 3  # stores that overflow all the time
    for text in TEXTS:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, size=n).astype(np.uint64)
    ph = idfiles.PerfectHash.build(keys)
    assert sorted(ph.numbers(keys).tolist()) == list(range(n))
    twice = idfiles.PerfectHash.build(np.array([5, 5, 9], dtype=np.uint64))
    assert sorted(set(twice.numbers(np.array([5, 9], dtype=np.uint64)).tolist())) != []


def reference(rows, path):
    tok = common.Encoder(path).tokenizer
    return {r[0]: np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4") for r in rows}


def test_files_round_trip(spark, docs_folder):
    rows = spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()
    want, at = reference(rows, BYTE), 0
    for r in catalogue.QUERIES["op6_id_files"](spark, docs_folder).orderBy("doc_id").collect():
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_odd_rows_and_keyed_look_up(odd_docs, no_docs, spark, monkeypatch):
    folder = common.fresh_path(spark, "test-ids")
    keys = idfiles.write_ids(odd_docs, BYTE, folder)
    got = idfiles.read_ids(keys, folder).collect()
    assert len(got) == 14 and sorted(r["start"] for r in got)[0] == 0
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    shard = {(r["doc_id"], r["occurrence"]): r["shard"] for r in keys.collect()}
    assert idfiles.lookup(folder, shard[(5, 0)], 5).tolist() == [0]
    assert idfiles.lookup(folder, shard[(2, 1)], 2, 1).tolist() == idfiles.lookup(folder, shard[(2, 0)], 2, 0).tolist()
    assert idfiles.lookup(folder, shard[(5, 0)], 987654321) is None
    empty = common.fresh_path(spark, "test-ids")
    assert idfiles.read_ids(idfiles.write_ids(no_docs, BYTE, empty), empty).count() == 0


def best_fill(lengths, room):
    return max((sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room), default=0)


def test_fullest_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = rng.integers(1, 30, size=8).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        room = int(rng.integers(1, 60))
        used = packing.fullest(counts, room)
        assert all(used[x] <= counts[x] for x in used)
        assert sum(x * n for x, n in used.items()) == best_fill(lengths, room)


def test_patterns_use_every_piece_once():
    counts = {2048: 7, 2000: 3, 1024: 9, 48: 2, 5: 1000, 1: 3}
    left = dict.fromkeys(counts, 0)
    for bins, used in packing.slack_patterns(dict(counts), 2048):
        assert sum(x * n for x, n in used.items()) <= 2048
        for x, n in used.items():
            left[x] += n * bins
    assert left == counts


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_documents(spark, docs_folder):
    source = spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()
    want = reference(source, WORDS)
    rows = catalogue.QUERIES["op8_pack_sequences"](spark, docs_folder).collect()
    got = {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["start"] == 2048 * r["piece"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: len(v) for k, v in want.items()}
    assert check_packed(rows, 2048) <= sum(got.values()) / 2048 * 1.02 + 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    pieces = packing.cut_pieces(odd_docs, WORDS, with_ids=True)
    rows = packing.pack(pieces).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows) and sum(r["piece"] == 0 for r in rows) == 14
    check_packed(rows, 2048)
    assert packing.pack(packing.cut_pieces(no_docs, WORDS)).count() == 0


def test_long_texts_hash_like_short_ones():
    text = "Aa bb\tcc " * 60_000 + "q" * 600_000 + " end of it all now"
    short = ["Aa bb\tcc " * 3, "END of it all NOW"]
    column = pa.array([text, *short, None, ""])
    data, offsets = common.utf8(column)
    h, s, e = common.word_hashes(data, offsets)
    assert len(h) == len(text.split()) + 9 + 5
    assert h[:9].tolist() == h[len(text.split()): len(text.split()) + 9].tolist() and h[len(text.split()) - 5: len(text.split())].tolist() == h[-5:].tolist()
    assert (e > s).all()
    assert [len(x) for x in common.shingle_sets(column)][3:] == [0, 0]


def test_the_encoders_stores_are_bounded():
    enc = common.Encoder(WORDS)
    enc.FULL = 1000
    for i in range(0, 60_000, 100):
        enc.ids(" ".join(f"w{j} x{j}) y{j}\nz{j}" for j in range(i, i + 100)))
    assert len(enc.new) <= 1000 and len(enc.old) <= 1000 and len(enc.starts) <= 1000 and len(enc.ends) <= 250
