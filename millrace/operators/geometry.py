"""Detection post-processing: suppression, proposals, matching, anchors, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B

XY = ("x1", "y1", "x2", "y2")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts groups to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def suppress(df: DataFrame, group: Sequence[str], threshold: float, most: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression within groups: the rows kept, by falling score (ties: box number).

    Where ``most`` is given, groups are cut to their best boxes first, as
    detectors do; the fold over a group's boxes costs kept times considered.
    """
    best = df if most is None else top_per_group(df, group, (F.desc("score"), F.asc("box")), most)
    packed = best.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "box", *XY, "score"))).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        over = F.exists(kept, lambda k: B.iou([k[c] for c in XY], [x[c] for c in XY]) > threshold)
        return F.when(over, kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return packed.select(*group, F.explode(kept).alias("k")).select(*group, "k.box", *(f"k.{c}" for c in XY), "k.score")


def proposals(df: DataFrame, image: str, level: str, pre: int, post: int, threshold: float) -> DataFrame:
    """Region proposals: best ``pre`` per image and level, suppression per level, best ``post`` per image."""
    kept = suppress(df, (image, level), threshold, pre)
    return top_per_group(kept, (image,), (F.desc("score"), F.asc("box")), post)


def match(predictions: DataFrame, truths: DataFrame, image: str, low: float, high: float, keep_low_quality: bool = True) -> DataFrame:
    """Best truth for each prediction: label 1 above ``high``, 0 below ``low``, -1 between.

    With ``keep_low_quality`` every prediction that is the best for some truth
    (ties too) is labelled 1.
    """
    t = truths.select(image, F.col("box").alias("truth"), *(F.col(c).alias(f"t_{c}") for c in XY))
    pairs = predictions.join(t, image).withColumn("iou", B.iou([F.col(c) for c in XY], [F.col(f"t_{c}") for c in XY]))
    pairs = pairs.withColumn("top", F.max("iou").over(Window.partitionBy(image, "truth")))
    best = pairs.groupBy(image, "box").agg(F.max_by("truth", F.struct("iou", -F.col("truth"))).alias("truth"), F.max("iou").alias("iou"), F.bool_or((F.col("iou") == F.col("top")) & (F.col("iou") > 0)).alias("is_top"))
    label = F.when(F.col("iou") >= high, 1).when(F.col("iou") < low, 0).otherwise(-1)
    if keep_low_quality:
        label = F.when(F.col("is_top"), 1).otherwise(label)
    return best.select(image, "box", "truth", "iou", label.alias("label"))


def cell_anchors(spark: SparkSession, sizes: Sequence[float], ratios: Sequence[float]) -> DataFrame:
    """Boxes around the origin for each size and aspect ratio (height over width)."""
    d = spark.range(1).select(F.posexplode(F.array(*map(F.lit, map(float, sizes)))).alias("i", "size")).select("i", "size", F.posexplode(F.array(*map(F.lit, map(float, ratios)))).alias("j", "ratio"))
    w = F.sqrt(F.col("size") * F.col("size") / F.col("ratio"))
    h = F.col("ratio") * w
    return d.select((F.col("i") * len(ratios) + F.col("j")).alias("anchor"), (-w / 2).alias("x1"), (-h / 2).alias("y1"), (w / 2).alias("x2"), (h / 2).alias("y2"))


def anchor_grid(cells: DataFrame, height: int, width: int, stride: int, offset: float = 0.0) -> DataFrame:
    """The cell anchors moved to every grid point; two generators, no join."""
    g = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    dx, dy = (F.col("col") + offset) * stride, (F.col("row") + offset) * stride
    return g.select("row", "col", "anchor", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


def pad(values: Column, most: int, fill: Column) -> Column:
    """The array, cut or filled to ``most`` elements."""
    return F.slice(F.concat(values, F.array_repeat(fill, most)), 1, most)


def subsample(df: DataFrame, group: Sequence[str], label: str, draw: Column, total: int, positive_share: float) -> DataFrame:
    """Up to ``total`` rows a group: at most the share of positives (label 1), the rest negatives (label 0), by lowest draw."""
    pos = top_per_group(df.where(F.col(label) == 1).withColumn("draw", draw), group, (F.asc("draw"),), int(total * positive_share))
    neg = df.where(F.col(label) == 0).withColumn("draw", draw)
    have = pos.groupBy(*group).agg(F.count(F.lit(1)).alias("have"))
    neg = top_per_group(neg, group, (F.asc("draw"),), total).join(have, list(group), "left").where(F.col("rank") <= total - F.coalesce("have", F.lit(0))).drop("have")
    return pos.unionByName(neg)
