"""The boundary to models: anything that maps batches of rows to batches of rows.

Weights are not part of the library.  A model is a factory that a worker calls
once, and that gives a function of Arrow batches; inference then is a
``mapInArrow`` with a declared schema.  Stub models make pipelines testable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[pa.RecordBatch], pa.RecordBatch]
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def apply_model(df: DataFrame, factory: Callable[[], Model], schema: str) -> DataFrame:
    """Runs a model over all rows; it is built once per task and sees one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            yield model(b)

    return df.mapInArrow(run, schema)


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Adds a task to the registry; an unknown task is a KeyError on use."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return add


def task(name: str) -> Callable[..., DataFrame]:
    return REGISTRY[name]


def hashed_embedder(key: str, text: str, size: int = 64) -> Callable[[], Model]:
    """A stub: unit vectors from character trigrams, equal for equal texts."""

    def factory() -> Model:
        import zlib

        def model(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in b.column(text).to_pylist():
                v = np.zeros(size)
                t = f"  {t or ''}  "
                for i in range(len(t) - 2):
                    h = zlib.crc32(t[i : i + 3].encode())
                    v[h % size] += 1 if h & 1 << 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            return pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.float64()))], names=[key, "vec"])

        return model

    return factory


@register("question-generation")
def question_generation(sentences: DataFrame, generate: Callable[[], Model], schema: str) -> DataFrame:
    """Distinct (answer, question) pairs of a generator over highlighted sentences."""
    return apply_model(sentences, generate, schema).distinct()


@register("multitask-qa-qg")
def multitask(rows: DataFrame, generate: Callable[[], Model], schema: str) -> DataFrame:
    return apply_model(rows, generate, schema)


@register("e2e-qg")
def end_to_end(texts: DataFrame, generate: Callable[[], Model], schema: str) -> DataFrame:
    return apply_model(texts, generate, schema)
