"""WARC archives: a writer with revisit records, and a reader of byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, text_or_empty, written
from .tables import query, table

MIN_BYTES = 0  # payloads from this size on are written once
ARCHIVE_BYTES = 1 << 30  # compressed bytes after which an archive is closed
SPLIT_BYTES = 1 << 24  # compressed bytes of a range
MOST_TASKS = 1 << 14
HOT_SHARE = 1000  # a payload with at least 1/1000 of the grouped rows is looked up in a broadcast table: at most so many
LEVEL = 6

MAGIC = b"\x1f\x8b\x08"
HEADER_BYTES = 1 << 20  # a longer header is no header
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, length long, records long"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ------------------------------------------------------------------ writing
def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record. Rows that repeat a page repeat its id."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    revisit = first is not None and first != page_id
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,-./:;=?@[]_~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(fields, http if revisit else http + payload)


class _Archive:
    """An archive that is being written. Its name is of this attempt alone, so a repeated task never meets its file; an
    archive counts only once its row is in the manifest."""

    def __init__(self, folder: str, date: str):
        self.uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = pafs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file, self.length, self.records = system.open_output_stream(path, compression=None), 0, 0
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self.put(_member(info, b"format: WARC File Format 1.1\r\n"))

    def put(self, member: bytes) -> None:
        self.file.write(member)
        self.length += len(member)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_pydict({"path": [self.uri], "length": pa.array([self.length], pa.int64()), "records": pa.array([self.records], pa.int64())})


def first_of_payload(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, body, digest, first): first is the smallest page_id among the rows with
    the same payload, if these are several and have an id, and the payload has at least min_bytes.

    Rows of a payload that many rows share (at least 1/1000 of all grouped rows, so at most 1000 payloads) are looked up in a broadcast table
    where they are; the others meet their group in a join by payload, so no payload makes a task large.
    """
    body = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"),
                        F.sha1(body).alias("digest"), F.xxhash64(body).alias("check"))
    big = rows.where(F.octet_length("body") >= min_bytes)
    groups = big.groupBy("digest", "check").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1 AND first IS NOT NULL")
    groups = written(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE >= total
    hot, cold = groups.where(is_hot).drop("n"), groups.where(~is_hot).drop("n")
    seen = F.broadcast(hot)
    here = rows.join(seen, ["digest", "check"])
    there = rows.join(seen, ["digest", "check"], "left_anti").join(cold, ["digest", "check"], "left")
    columns = ["page_id", "url", "body", "digest", "first"]
    return here.select(*columns).unionByName(there.select(*columns))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes a record of each row of pages(page_id, url, html) to archives below folder (a path that all executors share)
    and returns the written manifest (path, length, records).

    The payload is the html in UTF-8, empty for a null. Of rows with equal payloads of at least min_bytes the one with the
    smallest page_id is a response; the others are revisits, whose block ends with the HTTP header (it tells the payload's
    size). Rows that share the smallest id are responses all; without any id all are. A row without an id revisits the
    smallest. A null or empty url gives no target. An empty table gives no archive. Further columns are not read.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for page_id, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder, date)
                archive.put(_record(page_id, url, body, base32_sha1(bytes.fromhex(digest)), first, date))
                if archive.length >= archive_bytes:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    rows = first_of_payload(pages, min_bytes).withColumn("body", F.col("body").cast("binary"))
    return written(rows.mapInArrow(put, MANIFEST), "manifest")


# ------------------------------------------------------------------ reading
class Damaged(ValueError):
    """Bytes that are no WARC record in a gzip member."""


class Source:
    """A file read at any place, through one block that is kept."""

    BLOCK = 1 << 20

    def __init__(self, uri: str):
        uri = re.sub(r"^file:/(?!/)", "file:///", uri)
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.first, self.block = 0, b""

    def at(self, place: int, n: int) -> bytes:
        n = max(0, min(n, self.size - place))
        if not self.first <= place or place + n > self.first + len(self.block):
            self.first, self.block = place, self.file.read_at(min(max(n, self.BLOCK), self.size - place), place)
        return self.block[place - self.first: place - self.first + n]

    def close(self) -> None:
        self.file.close()


class Member:
    """The decoded content of a gzip member, read from front to back; a piece of it is in memory at a time."""

    def __init__(self, source: Source, place: int):
        self.source, self.next, self.step = source, place, 2048
        self.inflate = zlib.decompressobj(31)
        self.buffer = b""

    @property
    def end(self) -> int:
        """The place behind the member, once all of it is read."""
        return self.next - len(self.inflate.unused_data)

    def fill(self) -> bool:
        """More content behind what is in the buffer; False at the member's end (its checksum is then proven)."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.source.at(self.next, self.step)
                self.next += len(data)
                self.step = min(2 * self.step, 1 << 16)
            try:
                got = self.inflate.decompress(data, 1 << 18)
            except zlib.error as e:
                raise Damaged(str(e)) from None
            if got:
                self.buffer += got
                return True
            if not data and not self.inflate.eof:
                raise Damaged("the file ends inside a member")
        return False

    def head(self) -> list[bytes] | None:
        """The lines of a header up to an empty line; None if the member ends before it begins."""
        while b"\r\n\r\n" not in self.buffer:
            if len(self.buffer) > HEADER_BYTES or not self.buffer.startswith(b"WARC/"[: len(self.buffer)]) and len(self.buffer) >= 5:
                raise Damaged("no header")
            if not self.fill():
                if self.buffer:
                    raise Damaged("a header without an end")
                return None
        lines, self.buffer = self.buffer.split(b"\r\n\r\n", 1)
        return lines.split(b"\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if not self.buffer and not self.fill():
                raise Damaged("a record without an end")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def records_of(member: Member, with_payload: bool) -> Iterator[dict]:
    """The records of a member (mostly one). Digests are taken while the content streams by."""
    while (lines := member.head()) is not None:
        if not lines[0].startswith(b"WARC/"):
            raise Damaged("no header")
        fields = _fields(lines[1:])
        length = fields.get("content-length", "")
        if not length.isdecimal():
            raise Damaged("a record without a length")
        kind = fields.get("warc-type", "")
        http = fields.get("content-type", "").startswith("application/http")
        sha, size, kept, head = hashlib.sha1(), 0, [], b"" if http else None
        for piece in member.take(int(length)):
            if head is not None:
                head += piece
                if b"\r\n\r\n" not in head:
                    continue
                head, piece = head.split(b"\r\n\r\n", 1)
                web, head = _fields(head.split(b"\r\n")[1:]), None
                fields |= {f"http:{k}": v for k, v in web.items()}
            sha.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        b"".join(member.take(4))
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:").upper()
        if kind == "revisit":  # the payload is elsewhere
            stated = fields.get("http:content-length", "")
            size, digest, fine, kept = int(stated) if stated.isdecimal() else None, said or None, None, None
        else:
            digest = base32_sha1(sha.digest())
            fine = digest == said if said else None
        yield {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "payload_bytes": size,
               "payload_digest": digest, "digest_ok": fine, "refers_to": fields.get("warc-refers-to"), "payload": b"".join(kept) if with_payload and kept is not None else None}


def _begins(source: Source, place: int) -> bool:
    """Whether a member that decodes to the start of a record begins at place."""
    if source.at(place, 3) != MAGIC or source.at(place + 3, 1)[:1] > b"\x1f":
        return False
    try:
        member = Member(source, place)
        while len(member.buffer) < 5 and member.fill():
            pass
        return member.buffer[:5] == b"WARC/"
    except Damaged:
        return False


def members_from(source: Source, start: int, end: int, with_payload: bool = False, strict: bool = True) -> Iterator[tuple[int, list[dict]]]:
    """(place, records) of the members that begin in [start, end).

    The range is searched for the gzip magic. A candidate counts if it decodes as records up to its checksum and the file
    ends, or another record begins, right behind it; from there on one member follows the other. A damaged member is an
    error, or with strict=False the search goes on behind its first byte. A member's end may lie behind the range.
    (Bytes inside a payload that are themselves two or more members of a WARC file stored uncompressed could be mistaken
    for a start; UTF-8 text has no such bytes.)
    """
    place, known = start, start == 0
    while place < end:
        if not known:
            at = source.at(place, min(end + 2 - place, Source.BLOCK))
            hit = at.find(MAGIC)
            if hit < 0:
                place += max(1, len(at) - 2)
                continue
            place += hit
            if place >= end:
                return
            if not _begins(source, place):
                place += 1
                continue
        try:
            member = Member(source, place)
            found = list(records_of(member, with_payload))
            if not found:
                raise Damaged("a member without a record")
            if not known and member.end < source.size and not _begins(source, member.end):
                place += 1
                continue
        except Damaged as e:
            if known and strict:
                raise Damaged(f"at {place}: {e}") from None
            place, known = place + 1, False
            continue
        yield place, found
        place, known = member.end, True


RECORDS = "path string, place long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the archives in a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of archives files(path, length): path, place (of the member in the file), record_type, record_id,
    target_uri, payload_bytes, payload_digest (base32 SHA-1), digest_ok (whether it is the one the header states; null if
    none is stated), refers_to, and the payload if asked for. Of a revisit, bytes and digest are those its headers state.

    Files are cut into ranges of split_bytes, dealt to tasks; a task returns the records whose member begins in its range,
    so one large archive is read by many tasks and every record once. An empty manifest gives no rows.
    """
    spans = files.select("path", F.col("length").cast("long").alias("length")).where("length > 0")
    spans = spans.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # the size of a manifest row says nothing of the work behind it, so the number of tasks is given
    tasks = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    spans = spans.repartition(min(int(tasks), MOST_TASKS), "path", "start")
    schema = RECORDS + (", payload binary" if with_payload else "")
    kinds = [f.split() for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = Source(path)
                rows, held = [], 0
                for place, found in members_from(source, start, min(start + split_bytes, source.size), with_payload, strict):
                    for r in found:
                        rows.append({"path": path, "place": place, **r})
                        held += 256 + len(r["payload"] or b"")
                    if held >= 1 << 22:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)
                source.close()

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[k]) for n, k in kinds], [n for n, _ in kinds])

    return spans.mapInArrow(scan, schema)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
  b AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, count(*) OVER (PARTITION BY h) AS c, min(page_id) OVER (PARTITION BY h) AS f,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_BYTES} AND c > 1 AND f IS DISTINCT FROM page_id AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_BYTES} AND c > 1 AND f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM b
"""


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that `write` made of pages."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(-?[0-9]*):', 1) AS long)")
    rows = records.where(F.col("record_type").isin("response", "revisit"))
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


@query("op11_warc_archives", SQL)
def op11_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives by ranges."""
    to = fresh_path(spark, "warc")
    return page_records(read(write(table(spark, folder, "pages"), to)))
