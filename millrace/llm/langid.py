"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3
letters of words padded with ``_``), by falling count.  A text gets such a
list of its own; its distance to a profile is the sum over its n-grams of how
far each is out of place, with the profile's length for an absent one.  The
nearest profile wins.  Equal counts are ordered by the n-gram's letters, equal
distances by the language's name, so results don't depend on partitioning.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 400
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_WORDS_HELD = 400_000
_GRAMS_HELD = 400_000


class Grams:
    """Counts n-grams of whole texts; numbers them as they come."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.names: list[str] = []
        self.keys = np.zeros(1 << 12, np.int64)

    def _id(self, gram: str) -> int:
        i = self.ids.get(gram)
        if i is None:
            i = self.ids[gram] = len(self.names)
            self.names.append(gram)
            if i >= len(self.keys):
                self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.keys[i] = sum((ord(c) + 1) << (42 - 21 * j) for j, c in enumerate(gram))
        return i

    def _word(self, w: str) -> bytes:
        p, n = f"_{w}_", len(w)
        grams = [*w, *[p[i : i + 2] for i in range(n + 1)], *[p[i : i + 3] for i in range(n)]]
        known = list(map(self.ids.get, grams))
        if None in known:
            known = [self._id(g) for g in grams]
        out = array("i", known).tobytes()
        if len(w) <= 64:
            self.words[w] = out
        return out

    def count(self, text: str) -> np.ndarray:
        """Counts by n-gram number."""
        if len(self.words) > _WORDS_HELD:
            self.words.clear()
        get, make = self.words.get, self._word
        ids = np.frombuffer(b"".join([get(w) or make(w) for w in _WORD.findall(text.lower())]), np.int32)
        return np.bincount(ids, minlength=1)

    def full(self) -> bool:
        return len(self.names) > _GRAMS_HELD

    def top(self, counts: np.ndarray, n: int) -> np.ndarray:
        at = np.flatnonzero(counts)
        return at[np.lexsort((self.keys[at], -counts[at]))[:n]]


def _text(v: object) -> str:
    return v if isinstance(v, str) else ""


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, gram, n): each language's ``top`` n-grams over all rows with a non-null language.

    Each task sums counts per language before anything is shuffled.
    """
    src = df.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([grams.names[i] for i in at], pa.string()), pa.array(c[at], pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = grams.count(_text(t.as_py()))
                s = sums.get(name)
                if s is None or len(s) < len(c):
                    more = np.zeros(2 * len(c), np.int64)
                    if s is not None:
                        more[: len(s)] = s
                    s = sums[name] = more
                s[: len(c)] += c
                if grams.full():
                    yield from flush()
                    grams, sums = Grams(), {}
        yield from flush()

    counts = src.mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("lang", "rank", "gram", "n")


def identify(df: DataFrame, profiles: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """``df``'s columns other than the text, with lang_pred, score and margin.

    ``profiles`` has at most ``top`` rows a language; that many rows times the
    number of languages go to the driver.  Null texts and texts without a
    letter are ``und`` with score 0, as is everything when no profile exists.
    The score is 1 minus the distance over its greatest possible value; the
    margin is how much nearer the best profile is than the next.
    """
    learned: dict[str, dict[str, int]] = {}
    for r in profiles.collect():
        learned.setdefault(r["lang"], {})[r["gram"]] = r["rank"] - 1
    langs = sorted(learned)
    keep = [c for c in df.columns if c not in (text, "lang_pred", "score", "margin")]
    src = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        places = np.zeros((len(langs), 0), np.int64)
        for b in batches:
            pred, score, margin = [], [], []
            for t in b.column(len(keep)):
                plain = _text(t.as_py())
                have = grams.top(grams.count(plain), top)
                if not len(have) or not langs or not any(map(str.isalpha, plain)):
                    pred.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                    continue
                if places.shape[1] < len(grams.names):
                    new = grams.names[places.shape[1] :]
                    places = np.hstack([places, np.array([[learned[x].get(g, -1) for g in new] for x in langs], np.int64)])
                p = places[:, have]
                d = np.where(p < 0, top, np.abs(p - np.arange(len(have)))).sum(axis=1)
                order = np.lexsort((np.arange(len(langs)), d))
                most = len(have) * top
                pred.append(langs[order[0]])
                score.append(1.0 - int(d[order[0]]) / most)
                margin.append((int(d[order[1]]) - int(d[order[0]])) / most if len(langs) > 1 else 1.0)
                if grams.full():
                    grams, places = Grams(), np.zeros((len(langs), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=[*keep, "lang_pred", "score", "margin"])

    fields = [f"`{c}` {k}" for c, k in src.dtypes if c != "__text"]
    return src.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "margin double"]))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key's text leaves 2 modulo 4; never for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles)


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
