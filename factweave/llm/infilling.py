"""Fill-in-middle transformation by a secondary sort of unit chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, utf8
from .tables import query, table

SEED = 7
RATE = 100  # documents of 100 that are transformed
SPM_SHARE = 50  # of those, in suffix-prefix-middle order
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PLACE = {"": 0, "<P>": 0, "<M>": 1, "<S>": 2}  # where what follows a mark stood in the text
CHUNK = 1 << 14  # bytes of text in a piece: whole units, or a part of a longer unit
BATCH = 1 << 21  # bytes of text in a batch of pieces
SLICE = 512  # pieces looked at together
LAST = 1 << 62

PIECES = "key binary, pos long, copies long, mark string, body binary, doc_id long, n long, form string, prefix_chars long, middle_chars long"


def plan(doc_id: int | None, text: bytes, line_ends: np.ndarray, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> tuple[str, int, list[tuple[str, int, int]], int, int]:
    """(form, units, segments as (mark, first byte, last byte) in output order, end of the prefix, end of the middle) of one
    text; line_ends are the places behind its line ends."""
    units = len(line_ends) + (len(text) > (int(line_ends[-1]) if len(line_ends) else 0))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i: i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in MARKS.values()):
        return "plain", units, [("", 0, len(text))], 0, 0
    cuts = sorted((h1 % (units + 1), h2 % (units + 1)))
    a, b = (0 if c == 0 else len(text) if c == units else int(line_ends[c - 1]) for c in cuts)
    spans = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
    form = "spm" if h4 % 100 < spm_share else "psm"
    return form, units, [(MARKS[s], *spans[s]) for s in ORDER[form]], a, b


def chunks(first: int, last: int, line_ends: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most `size` from first to last that end at a unit's end, or inside a unit that is longer. An empty
    segment is one empty range."""
    while last - first > size:
        at = int(np.searchsorted(line_ends, first + size, side="right")) - 1
        cut = int(line_ends[at]) if at >= 0 and line_ends[at] > first else first + size
        yield first, cut
        first = cut
    yield first, last


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """The output of every text of docs(doc_id, text) as pieces, keyed by document and place in the output.

    `key` is a 128-bit hash of id and text, `copies` how many equal rows of a batch a piece stands for: equal rows have
    equal outputs, so they are combined before the shuffle and counted behind it. What a piece adds to the output is its
    `mark` and its `body`. The piece at place 0 carries what is known about the document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ends = np.flatnonzero(data[offsets[0]: offsets[-1]] == 10) + 1 + int(offsets[0])
            found: dict[bytes, list] = {}
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = int(offsets[row]), int(offsets[row + 1])
                hasher = hashlib.blake2b(f"{doc_id}:".encode(), digest_size=16)
                hasher.update(data[a:b])
                found.setdefault(hasher.digest(), [0, doc_id, a, b])[0] += 1
            out, held = [], 0
            for key, (copies, doc_id, a, b) in found.items():
                text = data[a:b].tobytes()
                mine = ends[np.searchsorted(ends, a, side="right"): np.searchsorted(ends, b, side="right")] - a
                form, units, segments, to_prefix, to_middle = plan(doc_id, text, mine, seed, rate, spm_share)
                about = (doc_id, units, form, None, None)
                if form != "plain":
                    about = (doc_id, units, form, len(text[:to_prefix].decode()), len(text[to_prefix:to_middle].decode()))
                pos = 0
                for mark, first, last in segments:
                    for s, e in chunks(first, last, mine):
                        out.append((key, pos, copies, mark, text[s:e], *(about if pos == 0 else (None,) * 5)))
                        pos, mark, held = pos + 1, "", held + e - s
                        if held >= BATCH:
                            yield _batch(out, PIECES)
                            out, held = [], 0
            if out:
                yield _batch(out, PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def by_place(rows: DataFrame) -> DataFrame:
    """Pieces dealt by document and sorted by place within it: the secondary sort."""
    return rows.repartition("key").sortWithinPartitions("key", "pos")


@dataclass
class _Document:
    key: bytes
    about: tuple
    copies: int = 0
    pos: int = -1
    segment: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    parts: list = field(default_factory=list)


def bodies_of(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of a binary column and where its values begin and end, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].tolist()
    return memoryview(data) if data is not None else memoryview(b""), at


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[_Document, str | None, memoryview, int]]]]:
    """(rows, events) of slices of the sorted pieces: an event is (document, mark, body, row) for each place of a document, and
    (document, None, nothing, -1) behind its last one. Rows of equal documents stand side by side and count once."""
    doc, rows = None, None
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            rows, events = batch.slice(first, SLICE), []
            key, pos, copies, mark = (rows.column(c).to_pylist() for c in range(4))
            data, at = bodies_of(rows.column(4))
            for i in range(len(key)):
                if doc is None or key[i] != doc.key:
                    if doc is not None:
                        events.append((doc, None, memoryview(b""), -1))
                    doc = _Document(key[i], tuple(rows.column(c)[i].as_py() for c in range(5, 10)))
                if pos[i] == 0:
                    doc.copies += copies[i]
                if pos[i] != doc.pos:
                    doc.pos = pos[i]
                    events.append((doc, mark[i], data[at[i]: at[i + 1]], i))
            yield rows, events
    if doc is not None:
        yield rows, [(doc, None, memoryview(b""), -1)]


RESTORED = "key binary, back long, body binary, copies long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of docs(doc_id, text).

    One shuffle deals the pieces by document; a sort by place lets each task stream a document's output into a digest,
    piece by piece. The stream is read as the output that it is: a mark says which segment follows, and so where a piece
    stood in the text. A second sort inside the same partitions (no shuffle) puts the pieces back, and their digest is
    that of the restored text. A task holds a batch of pieces, never a whole text.

    A null text is an empty one; an empty text or one that contains a mark stays plain; a null id hashes as no digits; ids
    may repeat and each row counts; an empty table gives no rows. Columns beyond doc_id and text are not read.
    """

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, events in _stream(batches):
            kept, back, ends = [], [], []
            for doc, mark, body, row in events:
                if mark is None:
                    ends.append((doc.key, LAST, b"", doc.copies, *doc.about, doc.digest.hexdigest()))
                    continue
                doc.digest.update(mark.encode())
                doc.digest.update(body)
                doc.segment = PLACE[mark] if mark else doc.segment
                kept.append(row)
                back.append((doc.segment << 40) + doc.pos)
            if kept:
                some = rows.select(["key", "body"]) if len(kept) == rows.num_rows else rows.select(["key", "body"]).take(pa.array(kept))
                nothing = [pa.nulls(len(kept), _ARROW[f.split()[1]]) for f in RESTORED.split(", ")[3:]]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(back), some.column(1), *nothing], [f.split()[0] for f in RESTORED.split(", ")])
            if ends:
                yield _batch(ends, RESTORED)

    result = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            out = []
            data, at = bodies_of(batch.column(2))
            for i, back in enumerate(batch.column(1).to_pylist()):
                if back != LAST:
                    digest.update(data[at[i]: at[i + 1]])
                    continue
                copies, *about, output = (batch.column(c)[i].as_py() for c in range(3, 10))
                row = (*about, output, digest.hexdigest())
                digest = hashlib.sha256()
                for _ in range(copies):
                    out.append(row)
                    if len(out) >= 10_000:
                        yield _batch(out, result)
                        out = []
            if out:
                yield _batch(out, result)

    whole = by_place(pieces(docs, seed, rate, spm_share)).mapInArrow(outputs, RESTORED)
    return whole.sortWithinPartitions("key", "back").mapInArrow(restored, result)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(doc_id, form, output): the transformed text of every row, put together from the same sorted pieces. A task holds one
    document's text at a time, as its row must."""
    schema = "doc_id long, form string, output string"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, events in _stream(batches):
            for doc, mark, body, _ in events:
                if mark is not None:
                    doc.parts += [mark.encode(), bytes(body)]
                    continue
                text = b"".join(doc.parts).decode()
                for _ in range(doc.copies):
                    yield _batch([(doc.about[0], doc.about[2], text)], schema)

    return by_place(pieces(docs, seed, rate, spm_share)).mapInArrow(texts, schema)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM k),
  s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""


@query("op12_fill_in_middle", SQL)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fill-in-middle form, with digests of the output and of the text restored from it."""
    return digests(table(spark, folder, "documents").select("doc_id", "text"))
