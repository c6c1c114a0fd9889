"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents.  All stages but the
last return the columns of ``documents``.  What ``mix`` decides is the order of
its rows; the files keep it, and what follows takes it from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, near_join, quality, sharding


#: Words of a shingle, and similarity as (numerator, denominator), from which documents are near copies here; op2's are its query's own.
NEAR_SHINGLE = 5
NEAR_THRESHOLD = (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the threshold; those without text go."""
    rated = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    graded = quality.grade(docs, quality.fit(docs, rated))
    return graded.where(F.col("p_top") >= quality.KEEP_TAIL).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by shingle similarity; rows that repeat a doc_id are one document."""
    comps = near_join.near_components(docs, shingle=NEAR_SHINGLE, threshold=NEAR_THRESHOLD)
    return _without(docs, comps.where("component_id <> doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item or its template."""
    return _without(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their slots in the mixing schedule; ``shard`` keeps this order."""
    return mixing.in_schedule_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard, sorted by shard and in it by the order in which ``mix`` has written them."""
    file, row = _ORDER
    placed = sharding.assign_shards(_numbered(docs))
    return placed.orderBy("shard", *_ORDER).drop(file, row)


#: Names of the columns that hold a row's place while it is sorted.
_ORDER = ("__written_file", "__written_row")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with each row's place: file and row of a stored table, which a reread that deals files by size can't lose, else the place as it comes.

    Spark names files by partition, ``part-`` and a number of five digits or more.
    """
    file, row = _ORDER
    try:
        about = docs.metadataColumn("_metadata")
        name = about.getField("file_name")
        number = F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
        place = docs.select("*", F.struct(number.alias("number"), name.alias("name")).alias(file), about.getField("row_index").alias(row))
        place.schema  # noqa: B018  (raises where the rows aren't those of files)
    except AnalysisException:
        place = docs.select("*", F.lit(0).alias(file), F.monotonically_increasing_id().alias(row))
    return place


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the doc_ids of ``gone``, which are stored first, so that the planner knows their size."""
    ids = near_join.stored(gone.select(F.col("doc_id").alias("__gone")).distinct(), "pipeline-gone")
    return docs.join(ids, F.col("doc_id") == F.col("__gone"), "left_anti")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_sources", mix),
    ("sharding", shard),
]

#: SQL cannot express the fitted classifier; tests hold the run against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' outcome for the documents of ``sf_dir``, by way of the shared folder; each shard's rows come in the order of ``mix``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = f"{near_join.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{to}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    file, row = _ORDER
    return _numbered(docs).orderBy("shard", file, row).drop(file, row)
