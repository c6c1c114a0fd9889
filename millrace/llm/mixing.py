"""Mixing sources to target weights by Pfair scheduling.

Source *i* with integer weight ``a`` out of a total ``A`` owns ``a`` of every
``A`` slots.  Its *j*-th block (from 0) is released at slot ``floor(j*A/a)``
and due by slot ``ceil((j+1)*A/a)``.  In each slot the released block with
the earliest deadline runs (ties: source order).  On one processor this keeps
every source within less than one block of its ideal share at every slot.

The schedule repeats after ``A`` slots, so one period is worked out on the
driver from the weights alone.  Every document gets a rank within its source,
a block number, and from the period table its slot.  No document is dropped:
when a source has run out its later slots stay empty, and ``in_mix`` tells
whether a slot lies before the first such gap, where the weights hold exactly.

Ranks come from a count per (source, bucket of the document's hash) and a row
number inside each such bucket, so that no task has a whole source to sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 16
BUCKET_DIGITS = 2
NO_SOURCE = ""


def pfair_period(weights: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the period, slot) for one period of ``sum(weights)`` slots."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    total = sum(weights.values())
    done = dict.fromkeys(sorted(weights), 0)
    period = []
    for slot in range(total):
        due, source = min((-(-(j + 1) * total // weights[s]), s) for s, j in done.items() if j < weights[s] and j * total // weights[s] <= slot)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        period.append((source, done[source], slot))
        done[source] += 1
    return period


def damped_weights(counts: DataFrame) -> DataFrame:
    """Weight of a source: the number of binary digits of its document count, so that large sources are damped."""
    return counts.select("__source", F.length(F.bin("__n")).alias("__weight"))


def _digest(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def mix_sources(df: DataFrame, key: str = "doc_id", source: str = "source", weights: Mapping[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(key, source, src_rank, block_no, slot, pos, in_mix) for every row of ``df``.

    ``weights`` maps sources to positive integers; without it the weights are
    ``damped_weights`` of the counts.  A source that ``weights`` lacks has
    weight 1; a null source is the source ''.  Rows with equal keys are
    ordered as they come, each with a rank of its own.  Only the list of
    sources with their counts goes to the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{source}`"), F.lit(NO_SOURCE)).alias("__source"))
    rows = rows.select("__key", "__source", _digest(F.col("__key")).alias("__hash")).withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS))
    sizes = rows.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    counts = sizes.groupBy("__source").agg(F.sum("__n").alias("__n"))
    per_source = {r[0]: (r[1], r[2]) for r in counts.join(damped_weights(counts), "__source").select("__source", "__n", "__weight").collect()}
    use = {s: (weights.get(s, 1) if weights else w) for s, (_, w) in per_source.items()}
    total = sum(use.values())
    period = pfair_period(use)
    slot_of = {(s, j): t for s, j, t in period}
    # the first slot that some source can no longer fill
    ends = []
    for s, (n, _) in per_source.items():
        last = -(-n // block)
        ends.append(last // use[s] * total + slot_of[s, last % use[s]])
    horizon = min(ends, default=0)
    table = spark.range(1).select(F.explode(F.from_json(F.lit(_json(period, use)), "array<struct<s:string,j:int,t:int,w:int>>")).alias("x")).select(F.col("x.s").alias("__source"), F.col("x.j").alias("__j"), F.col("x.t").alias("__t"), F.col("x.w").alias("__w"))
    own = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__key")
    ranked = rows.withColumn("__row", F.row_number().over(own)).join(starts, ["__source", "__bucket"]).withColumn("__rank", F.col("__row") - 1 + F.col("__start"))
    by = ranked.withColumn("__block", F.floor(F.col("__rank") / F.lit(block)))
    weight = table.groupBy("__source").agg(F.first("__w").alias("__sw"))
    by = by.join(_small(weight, len(period)), "__source").withColumn("__j", (F.col("__block") % F.col("__sw")).cast("int"))
    slot = F.floor(F.col("__block") / F.col("__sw")) * F.lit(total) + F.col("__t")
    return by.join(_small(table.drop("__w"), len(period)), ["__source", "__j"]).select(
        F.col("__key").alias(key), F.col("__source").alias(source), F.col("__rank").cast("bigint").alias("src_rank"), F.col("__block").cast("bigint").alias("block_no"), slot.cast("bigint").alias("slot"), (F.col("__rank") % block).cast("int").alias("pos"), (slot < F.lit(horizon)).alias("in_mix")
    )


def _json(period: list[tuple[str, int, int]], use: Mapping[str, int]) -> str:
    import json

    return json.dumps([{"s": s, "j": j, "t": t, "w": use[s]} for s, j, t in period])


def _small(table: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Broadcast a period table of up to ``most`` rows; beyond that the join is left to the planner."""
    return F.broadcast(table) if rows <= most else table


def in_schedule_order(df: DataFrame, key: str = "doc_id", source: str = "source", weights: Mapping[str, int] | None = None, block: int = BLOCK, within: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df``, all of them, sorted globally by the columns ``within``, if any, then by slot and position.

    Written out, the files read in name order are the mixed stream; a reader
    that deals files by size, as Spark's does, loses the order, and the same
    call on what it read restores it.  Rows
    with equal or null keys stay apart: the slot is joined by key and source
    once per distinct key.
    """
    plan = mix_sources(df, key, source, weights, block)
    plan = plan.groupBy(F.col(key).alias("__k"), F.col(source).alias("__s")).agg(F.min(F.struct("slot", "pos")).alias("__at"))
    on = F.col(f"`{key}`").eqNullSafe(F.col("__k")) & (F.coalesce(F.col(f"`{source}`"), F.lit(NO_SOURCE)) == F.col("__s"))
    return df.join(plan, on).orderBy(*(F.col(f"`{c}`") for c in within), F.col("__at.slot"), F.col("__at.pos")).select(*(F.col(f"`{c}`") for c in df.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


ORACLE = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS src_rank FROM documents),
    w AS (SELECT source, count(*) AS n, length(bin(count(*))) AS a, row_number() OVER (ORDER BY source) AS k FROM d GROUP BY source),
    c AS (SELECT list(a ORDER BY k) AS ws, sum(a)::BIGINT AS total FROM w),
    run(t, pick, done) AS (
        SELECT -1, 0, list_transform(ws, lambda a: 0::BIGINT) FROM c
        UNION ALL
        SELECT t + 1, p, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = p THEN 1 ELSE 0 END)
        FROM (
            SELECT t, done, list_sort(list_transform(list_filter(range(1, len(ws) + 1), lambda i: done[i] < ws[i] AND (done[i] * total) // ws[i] <= t + 1),
                lambda i: {{'due': ((done[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i}}))[1].i AS p
            FROM run, c WHERE t + 1 < total)),
    s AS (SELECT t AS slot, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM run WHERE t >= 0),
    p AS (SELECT w.source, w.n, w.a, s.j, s.slot AS t, c.total FROM s JOIN w ON w.k = s.pick, c),
    h AS (SELECT min((((n + {BLOCK - 1}) // {BLOCK}) // a) * total + t) AS horizon FROM p WHERE j = ((n + {BLOCK - 1}) // {BLOCK}) % a)
    SELECT doc_id, d.source, src_rank, src_rank // {BLOCK} AS block_no, ((src_rank // {BLOCK}) // a) * total + t AS slot, CAST(src_rank % {BLOCK} AS INTEGER) AS pos,
        ((src_rank // {BLOCK}) // a) * total + t < horizon AS in_mix
    FROM d JOIN p ON d.source = p.source AND (src_rank // {BLOCK}) % a = p.j, h"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": ORACLE}
