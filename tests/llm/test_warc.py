import base64
import gzip
import hashlib
import os
import zlib

import pytest

from factweave.llm import catalogue, common, warc


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, min_bytes=0):
    first = {}
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, html in rows:
        payload, f = (html or "").encode(), first.get(html or "")
        again = len(payload) >= min_bytes and f is not None and f != page_id
        out.append((page_id, len(payload), b32(payload), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_the_rule(spark, docs_folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{docs_folder}/pages.parquet").select("page_id", "html").collect()]
    assert rows_of(catalogue.QUERIES["op11_warc_archives"](spark, docs_folder)) == expected(rows)


ODD = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (2, None, "same"), (-3, "", "same"), (None, "http://n", "same"), (None, "http://n", "alone"), (5, "u", None), (6, "u", ""),
       (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "é語" * 200_000), (9, "u", "é語" * 200_000), (10, "ü", "z"), (11, "u", "HTTP/1.1 200 OK\r\n\r\n")]


@pytest.mark.parametrize("split", [50, 1000, 1 << 24])
def test_odd_pages_by_ranges(spark, split):
    df = spark.createDataFrame([(i, u, h) for i, u, h in ODD], "page_id long, url string, html string").selectExpr("*", "'d' as digest", "1 as first", "'b' as body", "2 as length", "'p' as path", "3 as n")
    files = warc.write(df.repartition(3), common.fresh_path(spark, "test-warc"))
    records = warc.read(files, split_bytes=split, with_payload=True)
    assert rows_of(warc.page_records(records)) == expected([(i, h) for i, _, h in ODD])
    got = records.where("record_type = 'response'").collect()
    assert all(r["digest_ok"] and b32(r["payload"]) == r["payload_digest"] for r in got)
    assert records.count() == files.selectExpr("sum(records)").first()[0]
    assert {r["target_uri"] for r in got if "same" == r["payload"].decode()} == {None}  # page -3 has an empty url
    some = warc.write(df, common.fresh_path(spark, "test-warc"), min_bytes=5, archive_bytes=300)
    assert some.count() > 3 and rows_of(warc.page_records(warc.read(some))) == expected([(i, h) for i, _, h in ODD], 5)


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(warc.read(warc.write(df, common.fresh_path(spark, "test-warc")))).count() == 0


def test_a_payload_of_a_third_of_all_rows(spark):
    df = spark.range(9000).selectExpr("id as page_id", "concat('http://x/', id) as url", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('pair ', id div 6) else concat('own ', id) end as html")
    rows = [tuple(r) for r in df.select("page_id", "html").collect()]
    got = warc.first_of_payload(df)
    assert rows_of(warc.page_records(warc.read(warc.write(df, common.fresh_path(spark, "test-warc"))))) == expected(rows)
    assert got.count() == 9000 and got.where("body = 'hot' and first = 0").count() == 3000


class Bytes(warc.Source):
    def __init__(self, raw, block=64):
        self.raw, self.size, self.first, self.block, self.BLOCK = raw, len(raw), 0, b"", block
        self.file = self

    def read_at(self, n, place):
        return self.raw[place: place + n]


def stored(content):
    """A member whose deflate block is stored, so that its content stands in the file as it is."""
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def record(payload, kind="resource"):
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_each_record_is_owned_by_the_range_it_begins_in():
    members = [gzip.compress(record(os.urandom(n) + warc.MAGIC * 3)) for n in (0, 1, 500, 3000, 10)]
    members.append(gzip.compress(record(b"first") + record(b"second of the member")))
    raw = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(len(members))]
    for split in (1, 13, 700, 5000):
        got = [(p, len(found)) for s in range(0, len(raw), split) for p, found in warc.members_from(Bytes(raw), s, min(s + split, len(raw)))]
        assert got == [(s, 1 + (s == starts[-1])) for s in starts]


def test_magic_inside_a_stored_payload_is_no_record():
    inner = gzip.compress(record(b"an archived record inside a payload"))
    raw = gzip.compress(record(b"a")) + stored(record(b"x" * 100 + inner + b"y" * 100)) + gzip.compress(record(b"b"))
    want = [0, len(gzip.compress(record(b"a"))), len(raw) - len(gzip.compress(record(b"b")))]
    for split in (37, 150):
        got = [p for s in range(0, len(raw), split) for p, _ in warc.members_from(Bytes(raw), s, min(s + split, len(raw)))]
        assert got == want


def test_damage_is_an_error_or_skipped():
    good = [gzip.compress(record(bytes([65 + i]) * 300)) for i in range(4)]
    bad = bytearray(good[1])
    bad[-6] ^= 255  # the checksum
    raw = good[0] + bytes(bad) + good[2] + good[3]
    with pytest.raises(warc.Damaged):
        list(warc.members_from(Bytes(raw), 0, len(raw)))
    got = [p for p, _ in warc.members_from(Bytes(raw), 0, len(raw), strict=False)]
    assert got == [0, len(raw) - len(good[2]) - len(good[3]), len(raw) - len(good[3])]
    with pytest.raises(warc.Damaged):
        list(warc.members_from(Bytes(good[0][:-3]), 0, len(good[0]) - 3))


def test_archives_of_a_folder(spark):
    folder = common.fresh_path(spark, "test-warc")
    df = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string")
    files = warc.write(df, folder)
    assert warc.archives(spark, folder).count() == files.count()
    assert rows_of(warc.page_records(warc.read(warc.archives(spark, folder)))) == expected([(1, "x"), (2, "x")])
