"""Token ids in raw files with a minimal perfect hash over the document keys."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, fresh_path, mix64, running_total, text_or_empty, tokenizer_path, written
from .tables import query, table

END = 0
SHARD_IDS = 1 << 22  # ids after which a shard is closed; the last document of a shard stays whole
MAGIC = b"FWID0001"
GAMMA = 2  # bits a key on each level
LEVELS = 48

# ------------------------------------------------------------------ minimal perfect hash
_SEED = np.uint64(0x9E3779B97F4A7C15)


def keys_of(doc_ids: pa.Array, occurrence: np.ndarray) -> np.ndarray:
    """64-bit keys of (document id, how many rows before have the same id); null is an id of its own."""
    ids = np.asarray(doc_ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
    null = np.asarray(doc_ids.is_null()).astype(np.uint64)
    return mix64(mix64(ids ^ (null * np.uint64(0xD6E8FEB86659FD93))) + occurrence.astype(np.uint64) * _SEED + null)


class PerfectHash:
    """A minimal perfect hash in levels of bits: a key that hashes to a place of its own on a level is settled there,
    the rest go on to the next. A key's number is the count of bits set before its own. Keys that no level settles
    (equal keys) are kept as a sorted list behind them."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level + 1) * int(_SEED) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = cls._place(left, len(sizes), size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(once, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~once[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.sort(left))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that is surely not in the set (another one may get a number)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            bit = self._place(keys[todo], level, size) + base
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.bits[word] >> shift) & np.uint64(1) == 1
            low = self.bits[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[todo[here]] = (self.before[word] + np.bitwise_count(low))[here]
            todo, base = todo[~here], base + size
            if not len(todo):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.before[-1] + at[hit]
        return out


# ------------------------------------------------------------------ the file format
# NAME.ids: the ids of the shard's documents one after the other, little-endian, 2 bytes each if the vocabulary
#   allows it, else 4.
# NAME.idx: MAGIC; bytes of an id, documents, ids, levels, words of bits, keys in the list (six u64); sizes of the
#   levels (u64); bits (u64); the list (u64); then by number of the key: fingerprint (u32), first id (u64), ids (u64).
def index_bytes(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    ph = PerfectHash.build(keys)
    order = np.empty(len(keys), dtype=np.int64)
    order[ph.numbers(keys)] = np.arange(len(keys))
    head = struct.pack("<6Q", width, len(keys), int(counts.sum()), len(ph.sizes), len(ph.bits), len(ph.rest))
    parts = [np.array(ph.sizes, "<u8"), ph.bits, ph.rest.astype("<u8"), fingerprints(keys)[order], starts[order].astype("<u8"), counts[order].astype("<u8")]
    return MAGIC + head + b"".join(p.tobytes() for p in parts)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype("<u4")


class Shard:
    """A shard opened for keyed reading."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        with self.fs.open_input_file(self.path + ".idx") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{uri}.idx is not an index of this format")
        self.width, n, self.ids, levels, words, rest = struct.unpack_from("<6Q", raw, 8)
        at = 8 + 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        sizes = take("<u8", levels)
        self.hash = PerfectHash([int(x) for x in sizes], take("<u8", words), take("<u8", rest))
        self.prints, self.starts, self.counts = take("<u4", n), take("<u8", n), take("<u8", n)
        self.payload = None

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, ids) of each key; -1 where the fingerprint says that the shard has no such key."""
        at = self.hash.numbers(keys)
        ok = (at >= 0) & (at < len(self.prints))
        ok[ok] = self.prints[at[ok]] == fingerprints(keys[ok])
        return np.where(ok, self.starts[np.where(ok, at, 0)].astype(np.int64) if len(self.starts) else -1, -1), np.where(ok, self.counts[np.where(ok, at, 0)].astype(np.int64) if len(self.counts) else -1, -1)

    def read(self, start: int, count: int) -> np.ndarray:
        if self.payload is None:
            self.payload = self.fs.open_input_file(self.path + ".ids")
        raw = self.payload.read_at(count * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def close(self) -> None:
        if self.payload is not None:
            self.payload.close()


def _put(uri: str, parts: list[bytes]) -> None:
    """A file that appears at once and whole, also if several attempts of a task write it."""
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
    with system.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    system.move(part, path)


KEYS = "doc_id long, occurrence int, shard string, shard_ids long"


def write_ids(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the ids of docs(doc_id, text) as shards below folder (a path that all executors share) in ascending order
    of doc_id, and returns the written key table: doc_id, occurrence, shard, and on a shard's first row shard_ids.

    Each text is encoded whole, then id 0 is appended; a null text is an empty one. Null ids come first; rows with one
    id stand in the order of a hash of the text and get the occurrences 0, 1, ...; an empty table writes no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([END], f"<u{width}").tobytes()
        part, shards = TaskContext.get().partitionId(), 0
        ids, occ, counts, chunks, total = [], [], [], [], 0
        last, seen = object(), 0

        def close() -> pa.RecordBatch:
            nonlocal shards, ids, occ, counts, chunks, total
            name = f"{part:07d}-{shards:05d}"
            n = np.array(counts, np.int64)
            keys = keys_of(pa.array(ids, pa.int64()), np.array(occ))
            _put(f"{folder}/{name}.ids", chunks)
            _put(f"{folder}/{name}.idx", [index_bytes(keys, np.cumsum(n) - n, n, width)])
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(occ, pa.int32()), pa.array([name] * len(ids)), pa.array([total] + [None] * (len(ids) - 1), pa.int64())], ["doc_id", "occurrence", "shard", "shard_ids"])
            shards, ids, occ, counts, chunks, total = shards + 1, [], [], [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = enc.ids(text.as_py())
                if width == 2:
                    got = np.frombuffer(got, "<u4").astype("<u2").tobytes()
                seen = seen + 1 if doc_id == last else 0
                last = doc_id
                ids.append(doc_id)
                occ.append(seen)
                counts.append(len(got) // width + 1)
                chunks += [got, end]
                total += counts[-1]
                if total >= SHARD_IDS:
                    yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(write, KEYS), "keys")


def read_ids(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each key of a key table, read from the shards by key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), dtype=object)
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if names[a] != name:
                    if shard:
                        shard.close()
                    name = names[a]
                    shard = Shard(f"{folder}/{name}")
                rows = batch.slice(a, b - a)
                first, count = shard.find(keys_of(rows.column(0), rows.column(1).to_numpy()))
                if (first < 0).any():
                    raise KeyError(f"shard {name} lacks a key that was written to it")
                crc = [zlib.crc32(shard.read(int(s), int(c)).astype("<u4").tobytes()) for s, c in zip(first, count)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(first + rows.column(3).to_numpy()), pa.array(count), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if shard:
            shard.close()

    shards = keys.where("shard_ids is not null").select("shard", "shard_ids")
    starts = running_total(shards, ["shard"], "shard_ids", "upto").select("shard", (F.col("upto") - F.col("shard_ids")).alias("first"))
    rows = keys.select("doc_id", "occurrence", "shard").join(starts, "shard").select("doc_id", "occurrence", "shard", "first")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "occurrence")
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, shard: str, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
    """The ids of one document, or None if the shard has no such key: one hash, one fingerprint, one ranged read."""
    s = Shard(f"{folder}/{shard}")
    first, count = s.find(keys_of(pa.array([doc_id], pa.int64()), np.array([occurrence])))
    got = None if first[0] < 0 else s.read(int(first[0]), int(count[0]))
    s.close()
    return got


@query("op6_id_files")
def op6_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum in files of byte-level ids, read back from the files by key."""
    to = fresh_path(spark, "ids")
    keys = write_ids(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), to)
    return read_ids(keys, to)
