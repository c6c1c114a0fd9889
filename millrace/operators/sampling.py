"""Reproducible sampling: draws are hashes of a key, the same in any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strs, uniform


def draw_lines(lines: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, line_no, ...): ``n`` draws with replacement from lines numbered 0 to count-1."""
    total = lines.count()
    draws = lines.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), "line", seed) * total).alias("line_no"))
    return lines.join(draws, "line_no").select("draw", *lines.columns)


def weighted_choice(key: Column, step: str, choices: Sequence[str], seed: int = 0) -> Column:
    """One of the choices; repeats in the list are its weights."""
    return F.get(strs(*choices), F.floor(uniform(key, step, seed) * len(choices)).cast("int"))


def keep_share(key: Column, step: str, share: Column | float, seed: int = 0) -> Column:
    return uniform(key, step, seed) < share


def reaugment(t: Column, pairs: Column, undo: bool = False) -> Column:
    """Replaces by an array of (augmented, plain) pairs, longest first; ``undo`` puts the augmented words back.

    The way back goes over numbered marks, so that a replacement isn't
    replaced again.
    """
    side = "plain" if undo else "augmented"
    order = F.array_sort(pairs, lambda a, b: F.when(F.length(a[side]) != F.length(b[side]), F.length(b[side]) - F.length(a[side])).when(a[side] < b[side], -1).when(a[side] > b[side], 1).otherwise(0))
    if not undo:
        return F.aggregate(order, t, lambda acc, p: F.replace(acc, p["augmented"], p["plain"]))
    mark = lambda i: F.concat(F.lit("**"), i.cast("string"), F.lit("**"))
    numbered = F.transform(order, lambda p, i: F.struct(p["augmented"].alias("a"), p["plain"].alias("p"), mark(i).alias("m")))
    marked = F.aggregate(numbered, t, lambda acc, p: F.replace(acc, p["p"], p["m"]))
    return F.aggregate(numbered, marked, lambda acc, p: F.replace(acc, p["m"], p["a"]))
