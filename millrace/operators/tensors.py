"""Layout, pooling, normalisation and losses on flat arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import let

#: Fixed value: label that no loss is taken of.
IGNORED = -100


def parts(v: Column, n: int, size: int) -> Column:
    """A flat array as ``n`` arrays of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * size + 1, F.lit(size)))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def moments(v: Column) -> Column:
    """Struct of ``mean`` and population ``var``."""
    return let(mean(v), lambda m: F.struct(m.alias("mean"), mean(F.transform(v, lambda x: (x - m) * (x - m))).alias("var")))


def mean_pool(v: Column, channels: int, size: int) -> Column:
    """Mean of each channel over its positions."""
    return F.transform(parts(v, channels, size), mean)


def group_norm(v: Column, groups: int, size: int, eps: float = 1e-5) -> Column:
    """Each group less its mean, over its standard deviation; one group is a layer norm."""
    scaled = lambda g: let(moments(g), lambda m: F.transform(g, lambda x: (x - m["mean"]) / F.sqrt(m["var"] + eps)))
    return F.flatten(F.transform(parts(v, groups, size), scaled))


def token_loss(logits: Column, label: Column) -> Column:
    """Cross entropy of a token's logits; 0 for the ignored label."""
    log_sum = let(F.array_max(logits), lambda m: m + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m))))
    return F.when(label == IGNORED, F.lit(0.0)).otherwise(log_sum - F.get(logits, label))


def mean_loss(loss: Column, label: Column) -> Column:
    """Aggregate: mean over the tokens that aren't ignored."""
    return F.avg(F.when(label != IGNORED, loss))


def permuted(v: Column, dims: Sequence[int], order: Sequence[int]) -> Column:
    """A flat array of shape ``dims`` with its axes in ``order``, flat again."""
    strides = [math.prod(dims[i + 1 :]) for i in range(len(dims))]
    new = [dims[o] for o in order]

    def source(i: Column) -> Column:
        at = F.lit(0)
        for k, axis in enumerate(order):
            at = at + F.floor(i / math.prod(new[k + 1 :])).cast("int") % new[k] * strides[axis]
        return at

    return F.transform(F.sequence(F.lit(0), F.lit(math.prod(dims) - 1)), lambda i: F.get(v, source(i)))


def gather(ids: DataFrame, embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``ids`` (with a column ``id``) with each id's row of an embedding table; unknown ids are left out."""
    return ids.join(embeddings.select(F.col(key).alias("id"), vector), "id")


def patch_scores(texts: DataFrame, images: DataFrame, image: str, k: int) -> DataFrame:
    """(image, text, patch, rank, score): each text's ``k`` best patches of its own image, by cosine (ties: first patch).

    ``texts`` has (image, text, vector), ``images`` (image, patches); scores of
    a text are worked out in its row, so that nothing but the join is shuffled.
    """
    units = images.select(image, F.transform("patches", lambda p: V.unit(V.as_double(p))).alias("__p"))
    both = texts.withColumn("__t", V.unit(V.as_double(F.col("vector")))).drop("vector").join(units, image)
    scored = F.transform(F.col("__p"), lambda p, i: F.struct((-F.round(V.dot(p, F.col("__t")), 9)).alias("o"), i.alias("patch")))
    best = both.select(image, "text", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("rank", "s"))
    return best.select(image, "text", F.col("s.patch").alias("patch"), (F.col("rank") + 1).alias("rank"), (-F.col("s.o")).alias("score"))


def large_region(x1: Column, y1: Column, x2: Column, y2: Column, least: float = 0.20) -> Column:
    """Whether a normalised box's mean side is worth an image of its own."""
    return ((x2 - x1) + (y2 - y1)) / 2.0 >= least


def pooler_boxes(boxes: DataFrame, batch: str, image: str) -> DataFrame:
    """``boxes`` with ``batch_index``, the place of their image in its batch (batches are bounded)."""
    return boxes.withColumn("batch_index", F.dense_rank().over(Window.partitionBy(batch).orderBy(image)) - 1)


def draw_order(boxes: DataFrame, image: str, area: Column, tie: str) -> DataFrame:
    """``boxes`` with ``place``: large boxes are drawn first, below the small ones."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(image).orderBy(area.desc(), tie)))


def batch_of(row: Column, size: int, checked_before: bool = False) -> Column:
    """Batch number of a row; a batch that is tested for more than ``size`` before a row is added holds one more."""
    return F.floor(row / (size + 1 if checked_before else size))


def parameter_shares(parameters: DataFrame, whole: int, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(part, n, share) of parameters (name, shape): sizes of those named after a group's words, and of all groups, in per cent of ``whole``."""
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda s, x: s * x)
    part = F.coalesce(*(F.when(F.col("name").rlike("|".join(words)), F.lit(g)) for g, words in groups.items()))
    sums = parameters.select(part.alias("part"), size.alias("n")).where("part IS NOT NULL").rollup("part").agg(F.sum("n").alias("n"))
    return sums.select(F.coalesce("part", F.lit("total")).alias("part"), "n", F.round(F.col("n") / whole * 100, 3).alias("share"))


def joint_sequence(text: Column, visual: Column, length: int) -> Column:
    """Struct of the joined ids, text padded with 0 to ``length``, and their mask."""
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(length) - F.size(text), F.lit(0)))
    ids = F.concat(text, pad, visual)
    return F.struct(ids.alias("ids"), F.concat(F.transform(text, lambda _: F.lit(1)), F.transform(pad, lambda _: F.lit(0)), F.transform(visual, lambda _: F.lit(1))).alias("mask"))
