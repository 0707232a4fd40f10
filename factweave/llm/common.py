"""Helpers the operators of this subpackage share: written tables, running totals, components, word hashes, token ids."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ tables in the shared folder
def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a one-machine session may go without: it gets a fresh one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factweave-llm-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/factweave-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends, a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Sum of `value` over all rows up to and with this one in the order of `order`, over the whole table.

    A global range sort, frozen by writing it; one sum per range partition; a running sum over those few; a running
    sum inside each partition.
    """
    cols = [F.col(c) for c in order]
    ranged = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: bounded by the session's partition count, not by the data
    base = ranged.groupBy("__part").agg(F.sum(value).alias("__s")).select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(base, "__part").withColumn(out, F.col("__base") + F.sum(value).over(inside)).drop("__part", "__base")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; what Arrow keeps of one is given back before the next, as a worker serves many tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


# ------------------------------------------------------------------ connected components
def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b) of longs: comp is the smallest node reachable. Nodes without an edge are not returned.

    Every round each node takes the smallest label among its neighbours' and its own (a combinable minimum), then the
    label of that label (pointer jumping), until no label changes; labels are written once a round.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        of = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = written(hooked.join(of, "comp").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        done = new.where("old <> comp").isEmpty()
        labels = new.select("node", "comp")
        if done:
            return labels


# ------------------------------------------------------------------ hashes of words, without a Python loop over words
_CHUNK = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2^64
_tables: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        inv = np.uint64(pow(int(_MUL), -1, 1 << 64))
        for base in (_MUL, inv):
            p = np.full(_CHUNK + 1, base, dtype=np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
    return _tables[0], _tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if off is not None and off.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most _CHUNK bytes that end at a text's end or, inside a long text, at white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + _CHUNK, end)
        if to < end:
            cut = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if cut <= at:
                b = data[at:to]
                space = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
                if len(space):
                    cut = at + int(space[-1]) + 1
                else:  # one word longer than a piece
                    cut = to
            to = cut
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word `WORD` of the texts, in order; A-Z count as a-z if `lower`."""
    powers, inverse = _powers()
    hashes, starts, ends = [], [], []
    for at, to in _pieces(data, offsets):
        b = data[at:to]
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.zeros(len(b) + 1, dtype=bool)
        inner = offsets[np.searchsorted(offsets, at): np.searchsorted(offsets, to, side="right")] - at
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = np.concatenate([[True], space])[:-1] | edge[:-1]
        after = np.concatenate([space, [True]])[1:] | edge[1:]
        s, e = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        v = b.astype(np.uint64)
        if lower:
            v[(b >= 65) & (b <= 90)] += np.uint64(32)
        v += np.uint64(1)
        v *= powers[: len(b)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        hashes.append(mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    split = np.flatnonzero(s[1:] == e[:-1])
    split = split[~np.isin(s[1:][split], offsets)]  # a word longer than a piece came in parts
    for i in split:
        h[i + 1: i + 2] = mix64(h[i: i + 1] * np.uint64(31) + h[i + 1: i + 2])
        s[i + 1] = s[i]
    keep = np.ones(len(h), dtype=bool)
    keep[split] = False
    return h[keep], s[keep], e[keep]


_MULS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of every run of n words (n at most 5); the order of the words counts."""
    m = max(0, len(words) - n + 1)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total += words[j: j + m] * _MULS[j]
    return mix64(total)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a text shorter than a run."""
    total = np.array([len(words)], dtype=np.uint64)
    for i in range(len(words)):
        total = mix64(total * _MULS[:1] + words[i: i + 1])
    return total


def shingle_sets(batch_text: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word runs (one for a shorter text, none for one without words)."""
    data, offsets = utf8(batch_text)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), side="right")) - 1)
        hi = min(hi, len(offsets) - 1)
        h, s, _ = word_hashes(data, offsets[lo: hi + 1])
        cuts = np.searchsorted(s, offsets[lo: hi + 1])
        grams = gram_hashes(h, n)
        for i in range(hi - lo):
            a, b = cuts[i], cuts[i + 1]
            if b - a >= n:
                g = np.sort(grams[a: b - n + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])]
            else:
                yield whole_hash(h[a:b]) if b > a else np.zeros(0, np.uint64)
        lo = hi


# ------------------------------------------------------------------ token ids by a public tokenizer
class Encoder:
    """Ids of whole texts by a file of the tokenizers library; a text is encoded in pieces between which the
    tokenizer never looks, and a piece seen lately is not encoded again.

    A piece ends before a single space between two other signs and around a single line end: a byte-level
    pre-tokenizer always cuts there, and a word-level one drops white space altogether. A comma or full stop between a
    letter or digit and white space is a piece of its own. A piece of Latin letters is one pre-token, so the tokenizer's model may have it
    directly; the constructor makes sure that this gives what the whole tokenizer gives.
    """

    FULL = 400_000  # pieces of at most 64 signs in each of two generations of the store; less for the other kinds
    _CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, full: int | None = None):
        self.FULL = full or self.FULL
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.space = "" if not self._raw(" ") else " "
        self.starts: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.marks = {"\1": self._raw(","), "\2": self._raw(".")}
        self.line_end = self._raw("\n")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level alphabet writes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.direct = True
        probe = [self.space + w for w in ("the", "Été", "schließen", "mañana", "xqzzv", "Straße")]
        self.direct = all(self._letters(w) == self._raw(w) for w in probe)

    def _raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, piece: str) -> bytes:
        word = piece if self.space else piece.lower()
        signs = word.replace(" ", self.byte_sign[32]) if word.isascii() else "".join(map(self.byte_sign.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _miss(self, word: str, space: str) -> bytes | None:
        """Ids of a piece (a space and a word, or a word that starts a line) that `new` lacks; None if white space at its edge
        forbids a cut there."""
        store = self.starts if self.space and not space else self.old
        got = store.get(word)
        if got is None and store is self.old:
            got = self.ends.get(word)
        if got is None:
            if self.direct and word.isalpha() and max(word) < "\u0250" and (self.space or word.lower().isalpha()):
                got = self._letters(space + word)
            elif word in self.marks:
                got = self.marks[word]
            elif not word:
                return None if self.space else b""
            elif self.space and (word[0].isspace() or word[-1].isspace()):
                return None
            else:
                got = self._raw(space + word)
            if len(word) > 64:
                return got
        if not space and self.space:
            if len(self.starts) >= self.FULL:
                self.starts.clear()
            self.starts[word] = got
            return got
        if not word[-1].isalnum() and word not in self.marks:  # kept apart: a mark after it may belong to it
            if len(self.ends) >= self.FULL // 4:
                self.ends.clear()
            self.ends[word] = got
            return got
        if len(self.new) >= self.FULL:
            self.old, self.new = self.new, {}
        self.new[word] = got
        return got

    def _slow(self, text: str) -> bytes:
        return b"".join(map(self._raw, self._CUT.split(text)))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "\1" in text or "\2" in text:
            return self._slow(text)
        whole = text
        for mark, sign in ((",", "\1"), (".", "\2")):
            text = text.replace(f"{mark} ", f" {sign} ").replace(f"{mark}\n", f" {sign}\n")
        if "\2 \1" in text:  # a run of marks
            return self._slow(whole)
        out: list[bytes] = []
        space = self.space
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.line_end)
            words = line.split(" ")
            have = list(map(self.new.get, words))
            if space:
                have[0] = self.starts.get(words[0]) if words[0][-1:].isalnum() else None
            if None in have:
                for j, x in enumerate(have):
                    if x is None:
                        word = words[j]
                        if j + 1 < len(words) and words[j + 1] in self.marks and not word[-1:].isalnum():
                            return self._slow(whole)
                        x = have[j] = self._miss(word, space if j else "")
                        if x is None:
                            return self._slow(whole)
            out += have
        return b"".join(out)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, full: int | None = None) -> Encoder:
    """One encoder a worker, file and size of its store; the store of pieces outlives a task."""
    if (path, full) not in _encoders:
        _encoders[path, full] = Encoder(path, full)
    return _encoders[path, full]
