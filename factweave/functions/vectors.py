"""Vector expressions and the default, deterministic text embedder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 256


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def calibrate(sim: Column, center: float = 0.65, steepness: float = 25.0) -> Column:
    """Logistic calibration of a raw cosine."""
    return 1.0 / (1.0 + F.exp(-steepness * ((sim + 1) / 2 - center)))


def calibrate_inverse(score: float, center: float = 0.65, steepness: float = 25.0) -> float:
    """Smallest raw cosine whose calibrated value reaches `score`."""
    return 2 * (center + float(np.log(score / (1 - score))) / steepness) - 1


def gram_counts(texts: pd.Series, dim: int = DIM) -> np.ndarray:
    """Hashed character-trigram counts, one row per text, computed for the whole batch at once.

    Texts are padded with one blank on each side; a gram of code points (a, b, c) falls in
    bucket (961 a + 31 b + c) mod dim.
    """
    padded = [" " + t + " " if isinstance(t, str) else "" for t in texts]
    lengths = np.fromiter((len(p) for p in padded), dtype=np.int64, count=len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32)
    codes = codes if dim & (dim - 1) == 0 else codes.astype(np.int64)  # a power of two divides 2^32, so sums may wrap
    out = np.zeros((len(padded), dim))
    if len(codes) < 3:
        return out
    rows = np.repeat(np.arange(len(padded)), lengths)
    same_text = rows[:-2] == rows[2:]
    bucket = (961 * codes[:-2] + 31 * codes[1:-1] + codes[2:]) % dim
    flat = np.bincount((rows[:-2] * dim + bucket)[same_text], minlength=len(padded) * dim)
    return flat.reshape(len(padded), dim).astype(np.float64)


def row_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    sims = np.einsum("ij,ij->i", a, b)
    return np.divide(sims, size, out=np.zeros_like(sims), where=size > 0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """Unit vector of a text (zero vector when the text has no gram)."""
    counts = gram_counts(texts)
    size = np.linalg.norm(counts, axis=1, keepdims=True)
    unit = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0).astype(np.float32)
    return pd.Series(list(unit))


CHUNK = 2_048  # pairs whose vectors are held at a time


def pair_cosine(a: pd.Series, b: pd.Series) -> np.ndarray:
    """row_cosine of the vectors of two columns of texts, CHUNK pairs at a time, each distinct text of these embedded once."""
    out = np.zeros(len(a))
    for at in range(0, len(a), CHUNK):
        (i, left), (j, right) = (pd.factorize(x.iloc[at: at + CHUNK], use_na_sentinel=False) for x in (a, b))
        out[at: at + CHUNK] = row_cosine(gram_counts(left)[i], gram_counts(right)[j])
    return out


@F.pandas_udf(T.DoubleType())
def text_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts without materialising their vectors as columns."""
    return pd.Series(pair_cosine(a, b))


def best_of(candidates: list[str]):
    """UDF factory: the candidate most similar to a text, first wins ties.

    `candidates` is a fixed vocabulary held in the closure (its size is the caller's to check).
    """
    labels = np.array(candidates, dtype=object)
    matrix = gram_counts(pd.Series(candidates))
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("candidate string, similarity double")
    def best(texts: pd.Series) -> pd.DataFrame:
        vecs = gram_counts(texts)
        size = np.linalg.norm(vecs, axis=1, keepdims=True)
        unit = np.divide(vecs, size, out=np.zeros_like(vecs), where=size > 0)
        # rounding makes "first wins" independent of summation order
        sims = np.round(unit @ matrix.T, 9)
        at = sims.argmax(axis=1)
        return pd.DataFrame({"candidate": labels[at], "similarity": sims[np.arange(len(at)), at]})

    return best


def best_in_context(candidates: list[str]):
    """UDF factory: argmax over candidates of cos("S candidate O", reference), first wins ties."""
    labels = np.array(candidates, dtype=object)

    @F.pandas_udf("candidate string, similarity double")
    def best(subject: pd.Series, obj: pd.Series, reference: pd.Series) -> pd.DataFrame:
        ref = gram_counts(reference)
        sims = np.empty((len(subject), len(candidates)))
        for j, cand in enumerate(candidates):
            phrase = (subject + " " + cand + " " + obj).str.lower().str.strip()
            sims[:, j] = row_cosine(gram_counts(phrase), ref)
        sims = np.round(sims, 9)
        at = sims.argmax(axis=1)
        return pd.DataFrame({"candidate": labels[at], "similarity": sims[np.arange(len(at)), at]})

    return best
