import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from factweave.llm import catalogue, langid, pii


def test_held_out_accuracy(spark, docs_folder):
    got = catalogue.QUERIES["op7_language_id"](spark, docs_folder).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and held and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_odd_rows_and_nothing_learned(odd_docs, no_docs):
    model = langid.learn(odd_docs)
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, model).where("doc_id is not null").collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6, 7}
    assert {r["lang_pred"] for r in got.values()} <= {"und", "en", "de"}
    nothing = langid.learn(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
    one = langid.fit(np.eye(4, langid.DIMS, dtype=np.float32), np.zeros(4, int), ["en"])
    assert one.predict(np.eye(4, langid.DIMS))[0].tolist() == [0] * 4


def test_codewords_mend_a_wrong_bit():
    for k in (2, 3, 4, 6, 30):
        code = langid.codewords(k)
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        assert gap >= (1 if k < 4 else 3)


def brute(t):
    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(x) if i % 2 == 0 else (int(x) * 2 - 9 if int(x) > 4 else int(x) * 2) for i, x in enumerate(d[::-1])) % 10 == 0:
            o.append(("card", *m.span()))
    return o + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "1", "2", "@", ".", ".", "-", "+", " ", "(", "4111111111111111", "255.", "b@c.d", "%", "é", "\n", "+1 588 555 18"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert brute(t) == pii.base_spans(t), t


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 2_000_000 + "1" * 2_000_000 + "." + "1." * 500_000 + "@" * 100_000) is not None


def test_query(spark, docs_folder):
    text = {r[0]: r[1] for r in spark.read.parquet(f"{docs_folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalogue.QUERIES["op10_personal_data"](spark, docs_folder).collect():
        base = brute(text[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        n = Counter(k for k, _, _ in base)
        assert [r[f"n_{k}"] for k in pii.BASE] == [n[k] for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_field_learns_its_table_and_decodes_exactly():
    field = pii.train()
    types, tags = pii._labelled()
    for x, y in zip(types, tags):
        fresh = np.zeros(len(x), bool)
        fresh[0] = True
        assert field.decode(field.emissions(x, fresh)[None], np.array([len(x)]))[0].tolist() == y.tolist()
    rng = np.random.default_rng(1)
    e = rng.normal(size=(1, 4, len(pii.TAGS))).astype(np.float32) * 3
    best = max(((sum(e[0, i, p[i]] for i in range(4)) + field.start[p[0]] + sum(field.pairs[p[i], p[i + 1]] for i in range(3))), p)
               for p in np.ndindex(*(len(pii.TAGS),) * 4) if field.start[p[0]] > -1e8 and all(field.pairs[p[i], p[i + 1]] > -1e8 for i in range(3)))
    assert field.decode(e, np.array([4]))[0].tolist() == list(best[1])


def test_field_finds_what_patterns_miss_and_leaves_plain_text():
    texts = ["please call (212) 555-0188 soon", "dear dr. Jane Miller hello", "the password=a1b2c3d4e5f6 leaked", "Thatou. Thtion was with the And of 1998", "é token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" x"]
    got = pii.field_spans(pa.array(texts), pii.train())
    found = [[(k, t[s:e]) for k, s, e in spans] for t, spans in zip(texts, got)]
    assert found == [[("local_phone", "(212) 555-0188")], [("person", "Jane Miller")], [("secret", "password=a1b2c3d4e5f6")], [], [("secret", "0641917ea4e9feb9cda83477b57ac2654884f485")]]


def test_odd_rows_and_redaction(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in pii.find(odd_docs).collect()}
    assert [got[10][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(odd_docs).collect()}
    assert clean[10] == "mail me at [EMAIL] or [PHONE] from [IP] card [CARD]" and clean[4] is None
    assert pii.find(no_docs).count() == 0 and pii.redact(no_docs).count() == 0
