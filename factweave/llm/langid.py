"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_by_one, text_or_empty
from .tables import query, table

DIMS = 1 << 12
SAMPLE = 500  # texts learned from of each language
LANGUAGES = 256  # languages learned at most, the most frequent ones
PIECE = 1 << 18  # signs of a text counted at once
UNKNOWN = "und"


# ------------------------------------------------------------------ features
def features(text: str) -> np.ndarray:
    """Counts of the 1-, 2- and 3-grams of the lower-case text's letters and spaces, hashed to DIMS places, as a vector
    of length one after a square root. The whole text counts, in pieces that overlap by two signs."""
    total = np.zeros(DIMS, dtype=np.float64)
    for at in range(0, max(len(text), 1), PIECE):
        c = np.frombuffer((" " + text[max(0, at - 2): at + PIECE].lower()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letter = (c >= 97) & (c <= 122) | (c >= 0xAA)
        c = np.where(letter, c, 32)
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        two = c[:-1] * 0x9E3B + c[1:]
        three = two[:-1] * 0x9E3B + c[2:]
        for g, salt in ((c, 1), (two, 2), (three, 3)):
            h = (g * 0x2545F491 + salt * 0x632BE5AB) & 0xFFFFFFFF
            total += np.bincount((h ^ (h >> 15)) % DIMS, minlength=DIMS)
    total = np.sqrt(total)
    size = np.linalg.norm(total)
    return (total / size if size else total).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


# ------------------------------------------------------------------ codewords
def codewords(classes: int) -> np.ndarray:
    """A row of +1 and -1 for each class: all ways to split up to 6 classes in two, else the best of 64 random codes of
    about 12 log2(classes) bits, by the least distance between two rows. Drawn from a fixed seed."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        bits = range(1, 1 << (classes - 1))
        return np.array([[1.0] * len(bits)] + [[1.0 if not b >> i & 1 else -1.0 for b in bits] for i in range(classes - 1)])
    rng, best, most = np.random.default_rng(7), None, -1
    n = int(np.ceil(12 * np.log2(classes)))
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(classes, n))
        gap = (n - np.abs(code @ code.T - n * np.eye(classes)).max()) / 2  # also keeps rows from being opposites
        if gap > most and (np.abs(code.sum(axis=0)) < classes).all():
            best, most = code, gap
    return best if best is not None else code


@dataclass
class Model:
    """Learned languages, their codewords, a linear classifier for each bit and the bits' weights for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row to each codeword: the bits' logistic losses, each by how well that bit's
        classifier did for the language."""
        margin = x.astype(np.float64) @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * self.code[k]) * self.trust[k]).sum(axis=1) for k in range(len(self.languages))], axis=1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest language, a score from 0 to 1, and whether the bits read lie too far from its codeword to be
        mended (half the least distance between two codewords, or more)."""
        d = self.losses(x)
        best = d.argmin(axis=1)
        p = np.exp(-(d - d.min(axis=1, keepdims=True)) * 2)
        read = np.where(x.astype(np.float64) @ self.weights + self.bias >= 0, 1.0, -1.0)
        wrong = (read != self.code[best]).sum(axis=1)
        k = len(self.languages)
        gap = min((int((self.code[i] != self.code[j]).sum()) for i in range(k) for j in range(i)), default=1)
        return best, p.max(axis=1) / p.sum(axis=1), (2 * wrong >= gap) & (k > 1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, decay: float = 1e-4) -> Model:
    """Logistic regression for each bit by accelerated gradient steps; a bit's weight for a language is its accuracy there."""
    code = codewords(len(languages))
    want = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, n = np.zeros_like(w), np.zeros_like(b), max(len(y), 1)
    each = 1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1)[y]  # languages count alike, however many texts
    each = (each / each.sum()).astype(np.float32)[:, None] if len(y) else np.zeros((0, 1), np.float32)
    rate = 8.0
    for _ in range(steps if n else 0):
        pull = -want / (1 + np.exp(np.clip(want * (x @ w + b), -30, 30))) * each
        vw = 0.9 * vw - rate * (x.T @ pull + decay * w).astype(np.float32)
        vb = 0.9 * vb - rate * pull.sum(axis=0).astype(np.float32)
        w, b = w + vw, b + vb
    hit = (np.where(x @ w + b >= 0, 1.0, -1.0) == want).astype(float)
    trust = np.stack([hit[y == k].mean(axis=0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(languages))]) if languages else np.zeros((0, 1))
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return Model(languages, code, w.astype(np.float64), b.astype(np.float64), trust)


# ------------------------------------------------------------------ on tables
def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled(doc_id, text, lang): rows with a null lang or a text without a letter teach nothing.

    At most `sample` texts of each of the LANGUAGES most frequent languages are used, the first by a hash of the id and
    the text, whole; only their feature vectors come to the driver (DIMS numbers each).
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.regexp_like(text_or_empty(), F.lit(r"\p{L}")))
    names = sorted(r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    if not names:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), [])
    keyed = rows.where(F.col("lang").isin(names)).select("lang", "doc_id", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "h")
    chosen = keyed.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    # at most LANGUAGES * sample rows
    picked = rows.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h")), "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    got = picked.select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    counts: dict[str, int] = {}
    kept = []
    for r in got:  # repeated rows could give more than the sample
        counts[r[0]] = counts.get(r[0], 0) + 1
        if counts[r[0]] <= sample:
            kept.append(r)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in kept]).astype(np.float32)
    at = {k: i for i, k in enumerate(names)}
    return fit(x, np.array([at[r[0]] for r in kept]), names)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with lang_pred, score and ambiguous, from the text alone.

    A null text, an empty one or one without a letter, and any text if no language was learned, gets `und`, score 0, not
    ambiguous. Columns of docs named like the new ones are replaced; an empty table gives an empty result.
    """
    new = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in docs.columns if c not in new]
    at = keep.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in one_by_one(batches):
            for lo in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(lo, 512)
                lang, score, odd = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows, [False] * part.num_rows
                rows, x = [], []
                for i in range(part.num_rows):
                    text = part.column(at)[i].as_py()
                    if text and model.languages and has_letter(text):
                        rows.append(i)
                        x.append(features(text))
                if rows:
                    for i, k, p, a in zip(rows, *model.predict(np.stack(x))):
                        lang[i], score[i], odd[i] = model.languages[k], float(min(1.0, max(0.0, p))), bool(a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd, pa.bool_())], [*keep, *new])

    told = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*[f for f in docs.schema if f.name not in new], *told])
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(predict, schema)


def fold() -> Column:
    """True for the documents held out of learning; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~fold()))
    return identify(docs.select("doc_id", fold().alias("held_out"), "text"), model).drop("text")
