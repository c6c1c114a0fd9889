"""Quality grades by ordinal cumulative-link regression.

A text becomes a set of hashed features: its distinct words, and coarse levels
of its make-up (share of capitals, of symbols, of digits, of repeated words,
word length, size).  One weight vector is shared by all grades; ordered
thresholds cut its score: ``P(grade <= k) = sigmoid(threshold_k - w.x)``.
The fit minimises the negative log-likelihood with an L1 penalty by
accelerated proximal gradient steps, so that words without evidence weigh
nothing.  From the same probabilities come the expected grade and the tail
probability ``P(grade >= k)`` by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix64, string_chunks, text_words

BITS = 18
#: Most labelled rows that a fit uses, those with the least MD5 of their key.
FIT_ROWS = 8000
L1 = 2.0
STEPS = 400
KEEP_TAIL = 0.5
_LEVELS = np.array([0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.6])
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[33, *range(35, 39), 42, 43, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = True


def feature_sets(col: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each row's whole text; none for null or empty text."""
    mask = np.uint64((1 << bits) - 1)
    for _, data, offs in string_chunks(col):
        h, first = text_words(data, offs)
        ids = (h & mask).astype(np.int64)
        counts = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _SYMBOL, _DIGIT)]
        for lo, hi, a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi == lo:
                yield np.zeros(0, np.int32)
                continue
            words = np.unique(ids[a:b])
            shares = [(c[hi] - c[lo]) / (hi - lo) for c in counts] + [1 - len(words) / max(1, b - a)]
            levels = [int(np.searchsorted(_LEVELS, s, side="right")) for s in shares]
            levels += [min(15, int((hi - lo) / max(1, b - a))), (hi - lo).bit_length()]
            shape = mix64(np.array([100 * i + v for i, v in enumerate(levels)], np.uint64), 41) & mask
            yield np.unique(np.concatenate([words, shape.astype(np.int64)])).astype(np.int32)


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights and ordered thresholds; grades are 0 to ``len(thresholds)``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, bits: int = BITS, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Fit on rows of feature numbers and grades 0, 1, ...; the rows' order makes no difference but for rounding.

    Without rows, or with one grade only, all weights are 0.
    """
    top = int(grades.max()) if len(grades) else 0
    share = [np.clip((grades <= k).mean(), 1e-4, 1 - 1e-4) if len(grades) else 0.5 for k in range(max(1, top))]
    theta = np.log(np.array(share) / (1 - np.array(share)))
    full = 1 << bits
    if not len(grades) or grades.min() == grades.max():
        return OrdinalModel(np.zeros(full), theta)
    idx = np.concatenate(features).astype(np.int64)
    used, col = np.unique(idx, return_inverse=True)
    sizes = np.array([len(f) for f in features])
    row = np.repeat(np.arange(len(features)), sizes)
    n, m = len(features), len(used)
    w = np.zeros(m)

    def gradient(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.bincount(row, w[col], minlength=n)
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = 1 / (1 + np.exp(-np.clip(cut[grades + 1] - s, -60, 60))), 1 / (1 + np.exp(-np.clip(cut[grades] - s, -60, 60)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_theta = np.bincount(grades, -du, minlength=top + 1)[:top] + np.bincount(grades, dl, minlength=top + 1)[1:]
        return np.bincount(col, (du - dl)[row], minlength=m), g_theta

    # Columns differ widely in how many rows they have, so each has a step of its own; the
    # largest eigenvalue of the scaled problem (power iteration; the curvature is at most 1/2) makes them safe.
    scale = np.bincount(col, minlength=m).astype(float)
    v = np.sqrt(scale)
    for _ in range(30):
        v = np.bincount(col, np.bincount(row, (v / np.sqrt(scale))[col], minlength=n)[row], minlength=m) / np.sqrt(scale)
        top_value = np.linalg.norm(v)
        v /= top_value
    size = 2.0 / (1.1 * top_value * scale)
    z, z_theta, t = w.copy(), theta.copy(), 1.0
    for _ in range(steps):
        g, g_theta = gradient(z, z_theta)
        w2 = z - size * g
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - size * l1, 0)
        theta2 = np.sort(z_theta - 2.0 / (1.1 * top_value * n) * g_theta)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, z_theta = w2 + (t - 1) / t2 * (w2 - w), theta2 + (t - 1) / t2 * (theta2 - theta)
        if ((z - w2) * (w2 - w)).sum() < 0:  # restart when momentum points uphill
            t2, z, z_theta = 1.0, w2, theta2
        w, theta, t = w2, theta2, t2
    out = np.zeros(full)
    out[used] = w
    return OrdinalModel(out, np.sort(theta))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 2 good, 1 of low quality, 0 toxic; labels with a null are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select("doc_id", grade.alias("grade"))


def fit(docs: DataFrame, rated: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", rows: int = FIT_ROWS, bits: int = BITS) -> OrdinalModel:
    """Fit on at most ``rows`` rated documents, chosen by the MD5 of their key.

    Of these only hashed features come to the driver.  Their ids, ``rows`` at
    most, are broadcast, so that the documents aren't shuffled.
    """
    some = rated.select(F.col(key).alias("__key"), F.col(grade).cast("int").alias("__grade")).orderBy(F.md5(F.col("__key").cast("string")), "__key", "__grade").limit(rows)
    src = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text")).join(F.broadcast(some), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in feature_sets(b.column("__text"), bits)]
            yield pa.RecordBatch.from_arrays([b.column("__key").cast(pa.string()), b.column("__grade"), pa.array(sets, pa.binary())], names=["k", "g", "f"])

    got = sorted((r.k, r.g, bytes(r.f)) for r in src.mapInArrow(run, "k string, g int, f binary").collect())
    return fit_ordinal([np.frombuffer(f, np.int32) for _, _, f in got], np.array([g for _, g, _ in got], np.int64), bits)


def grade(df: DataFrame, model: OrdinalModel, text: str = "text", bits: int = BITS) -> DataFrame:
    """``df`` with expected_grade and p_top, the probability of the highest grade (existing columns of these names are replaced).

    Null and empty texts have no evidence and get null for both; equal texts
    get equal values.  The model is a fixed ``2**bits`` weights.
    """
    made = ("expected_grade", "p_top")
    keep = [c for c in df.columns if c not in made]
    at = keep.index(text)
    src = df.select(*(F.col(f"`{c}`") for c in keep))
    shared = src.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values, theta = shared.value
        w = np.zeros(1 << bits)
        w[where] = values
        m = OrdinalModel(w, theta)
        for b in batches:
            expected, p_top = [], []
            for f in feature_sets(b.column(at), bits):
                tails = m.tails(m.score(f)) if len(f) else None
                expected.append(None if tails is None else float(tails.sum()))
                p_top.append(None if tails is None else float(tails[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected, pa.float64()), pa.array(p_top, pa.float64())], names=[*keep, *made])

    return src.mapInArrow(run, ", ".join([f"`{c}` {k}" for c, k in src.dtypes] + [f"{c} double" for c in made]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade(docs, model).select("doc_id", "expected_grade", "p_top", (F.coalesce(F.col("p_top"), F.lit(0.0)) >= KEEP_TAIL).alias("keep"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
