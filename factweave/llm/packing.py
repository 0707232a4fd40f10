"""Best-fit packing by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, one_by_one, text_or_empty, tokenizer_path, written
from .tables import query, table

CAPACITY = 2048
END = 0
SLICES = 1024


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, store: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): the ids of each whole text and an id 0 behind
    them, cut into pieces of `capacity`; the last piece may be shorter. A null text is an empty one; ids may be null or
    repeat; an empty table gives no piece. `store` is how many words the encoder keeps (the ids do not depend on it)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, store)
        end = np.array([END], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])

        for batch in one_by_one(batches):
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = enc.ids(text.as_py()) + end
                n = len(raw) // 4
                for i, s in enumerate(range(0, n, capacity)):
                    part = raw[4 * s: 4 * (s + capacity)]
                    rows.append((doc_id, i, s, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                held += len(raw) if with_ids else 64
                if held >= 1 << 22:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each is taken of the fullest combination of `counts` that fits `room`.

    Subset sums as bits of one integer: a length shifts what is reachable; copies go in as 1, 2, 4, ... at once. It stops
    as soon as `room` itself is reachable, and then goes back over the shifts.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach = (reach | (reach << (length * k))) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, lengths in each) by minimum bin slack: each bin takes the longest piece left and the fullest
    combination of what is left for the rest of it.

    Only lengths matter, so a bin's combination is taken for as many bins as the counts allow; each such step uses up
    some length, and there are at most `capacity` lengths, whatever the number of pieces.
    """
    counts = {x: n for x, n in counts.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest({x: n for x, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * bins
            if not counts[x]:
                del counts[x]
        out.append((bins, used))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, ids_crc32, length from 1 to capacity, ...) with sequence_id and offset (gapless from 0).

    The histogram of lengths (at most `capacity` numbers) comes to the driver, where `slack_patterns` makes the bins.
    The pieces of a length are numbered on two levels (a slice of a hash, a place in it), so a common length is not one
    task, and a piece's number says its bin. Pieces of one length may be swapped without loss: equal rows are no trouble.
    """
    pieces = written(pieces, "pieces")
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)).cast("int"))
    sizes = written(sliced.groupBy("length", "__slice").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {int(r[0]): int(r[1]) for r in sizes.groupBy("length").agg(F.sum("n")).collect()}

    # one entry for each length of a pattern: first number, pieces in a bin, first bin, place in the bin
    entries, bins, upto = [], 0, dict.fromkeys(counts, 0)
    for times, used in slack_patterns(counts, capacity):
        place = 0
        for length, n in sorted(used.items(), reverse=True):
            entries.append((length, upto[length], n, bins, place))
            upto[length] += n * times
            place += n * length
        bins += times
    entries.sort()
    length, first, each, bin0, place = (np.array(x, dtype=np.int64) for x in (zip(*entries) if entries else [()] * 5))
    by = length * (1 << 44) + first

    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.join(base, ["length", "__slice"]).withColumn("__rank", F.col("__base") + F.row_number().over(inside) - 1)
    ranked = ranked.select(*pieces.columns, "__rank")
    names = [*pieces.columns, "sequence_id", "offset"]
    at_length, at_rank = pieces.columns.index("length"), len(pieces.columns)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            n, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            i = np.searchsorted(by, n * (1 << 44) + rank, side="right") - 1
            nth = rank - first[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bin0[i] + nth // each[i]), pa.array(place[i] + nth % each[i] * n)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(put, f"{fields}, sequence_id long, offset long")


@query("op8_pack_sequences")
def op8_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack(cut_pieces(docs, tokenizer_path("word_bpe_49k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
