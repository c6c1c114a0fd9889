"""Line-addressable corpora: numbering, lookup, offsets and full-text search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = 4096
#: Words, and bytes of lines, in a file of a stored index; small tables have the number of files asked for.
FILE_WORDS = 2_000_000
FILE_BYTES = 64 << 20


def number_lines(df: DataFrame, doc: str = "doc_id", pos: str = "pos", step: int = STEP) -> DataFrame:
    """``df`` with ``line_no`` from 0 in order of document and position.

    Counts per document add up within blocks of ``step`` ids, those of the
    blocks within as many blocks, and those of these over their list, a
    ``step`` * ``step``-th of the range of ids: no task orders all lines, nor all blocks.
    """
    sizes = df.groupBy(doc).agg((F.max(pos) + 1).alias("__n")).withColumn("__b", F.floor(F.col(doc) / step)).withColumn("__t", F.floor(F.col("__b") / step))
    blocks = sizes.groupBy("__t", "__b").agg(F.sum("__n").alias("__bn"))
    tops = blocks.groupBy("__t").agg(F.sum("__bn").alias("__tn"))
    before = lambda n, by, *within: F.coalesce(F.sum(n).over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = tops.select("__t", before("__tn", "__t").alias("__top_at"))
    at = blocks.select("__t", "__b", before("__bn", "__b", "__t").alias("__block_at")).join(at, "__t").select("__b", (F.col("__block_at") + F.col("__top_at")).alias("__at"))
    starts = sizes.select(doc, "__b", before("__n", doc, "__b").alias("__in")).join(at, "__b").select(doc, (F.col("__at") + F.col("__in")).alias("__start"))
    return df.join(starts, doc).withColumn("line_no", F.col("__start") + F.col(pos)).drop("__start")


def write_index(lines: DataFrame, path: str, partitions: int) -> None:
    """Lines as Parquet, ranged and sorted by number: point and range lookups prune by the files' statistics.

    ``partitions`` is the least number of files, large tables have more.
    """
    size = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    lines.repartitionByRange(max(partitions, -(-size // FILE_BYTES)), "line_no").sortWithinPartitions("line_no").write.parquet(path)


def lookup_range(lines: DataFrame, start: int, stop: int) -> DataFrame:
    """Lines ``start`` to ``stop``, half open."""
    return lines.where((F.col("line_no") >= start) & (F.col("line_no") < stop))


def lookup_list(lines: DataFrame, keys: Sequence[int]) -> DataFrame:
    """(pos, line_no, ...) for the given numbers, with their order and repeats."""
    if not keys:
        return lines.where(F.lit(False)).select(F.lit(0).alias("pos"), *(c for c in lines.columns if c != "pos"))
    wanted = lines.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(k).cast("bigint") for k in keys))).alias("pos", "line_no"))
    return lines.where(F.col("line_no").isin(*set(keys))).select(*(c for c in lines.columns if c != "pos")).join(F.broadcast(wanted), "line_no").select("pos", *(c for c in lines.columns if c != "pos"))


def offsets(lines: DataFrame, group: str, pos: str, line: str) -> DataFrame:
    """Byte offset of each line in its group, lines ending with one byte."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length(line) + 1).over(w), F.lit(0)))


def terms(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len); one shuffle by key and term after partial counting."""
    d = docs.select(key, terms(F.col(text)).alias("w")).select(key, F.size("w").alias("len"), F.explode("w").alias("term"))
    return d.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == F.lit(term)))


def gain(tf: Column, length: Column, df: int, n: int, avg: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a term that ``df`` of ``n`` texts have adds to a text's BM25 score."""
    idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avg)))


def bm25(docs: DataFrame, key: str, text: str, wanted: Sequence[str], top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``top`` rows that hold all wanted terms, by BM25 score (ties: key). A top-k report."""
    d = docs.select(key, terms(F.col(text)).alias("w")).select(key, F.size("w").alias("len"), *(_times(t).alias(f"tf{i}") for i, t in enumerate(wanted)))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(wanted)))).first()
    score = F.lit(0.0)
    hit = F.lit(True)
    for i in range(len(wanted)):
        tf = F.col(f"tf{i}")
        score = score + gain(tf, F.col("len"), stats[f"df{i}"], stats["n"], stats["avg"], k1, b)
        hit = hit & (tf > 0)
    return d.where(hit).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(top)


def write_terms(docs: DataFrame, key: str, text: str, path: str, partitions: int) -> None:
    """A search index: terms ranged and sorted, so that a search prunes by the files' statistics, and the counts it needs.

    ``partitions`` is the least number of files, large tables have more; a
    frequent term's rows go to several, in the order of the key.
    """
    docs.select(F.size(terms(F.col(text))).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).write.parquet(f"{path}/counts")
    counts = docs.sparkSession.read.parquet(f"{path}/counts").first()
    words = int(counts["n"] * (counts["avg"] or 0))
    found = inverted_index(docs, key, text).withColumnRenamed(key, "key")
    found.repartitionByRange(max(partitions, -(-words // FILE_WORDS)), "term", "key").sortWithinPartitions("term", "key").write.parquet(f"{path}/terms")


def search_terms(spark: SparkSession, path: str, wanted: Sequence[str], top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) as ``bm25`` gives them, from the stored index: only the wanted terms' rows are read."""
    asked = sorted(set(wanted))
    rows = spark.read.parquet(f"{path}/terms").where(F.col("term").isin(asked))
    counts = spark.read.parquet(f"{path}/counts").first()
    df = {r["term"]: r["count"] for r in rows.groupBy("term").count().collect()}
    if len(df) < len(asked):
        return rows.where(F.lit(False)).select("key", F.lit(0.0).alias("score"))
    score = F.lit(0.0)
    for t in wanted:
        score = score + F.max(F.when(F.col("term") == t, gain(F.col("tf"), F.col("len"), df[t], counts["n"], counts["avg"], k1, b)))
    hits = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__hits"), score.alias("score")).where(F.col("__hits") == len(asked))
    return hits.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(top)
