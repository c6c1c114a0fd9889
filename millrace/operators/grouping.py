"""Deduplication and grouping of ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: Column, order: Column, value: Column, name: str = "value") -> DataFrame:
    """One row per key: the value of the row last in order."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, order).alias(name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the given order; partial aggregation, no sort of whole groups."""
    kept = df.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in df.columns if c not in order))).alias("__row"))
    return kept.select("__row.*").select(*df.columns)


def collapse_runs(df: DataFrame, group: Sequence[str], order: str, key: str) -> DataFrame:
    """``df`` with ``run``: neighbours in order with equal keys have the same number within their group."""
    w = Window.partitionBy(*group).orderBy(order)
    start = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__start", start).withColumn("run", F.sum("__start").over(w)).drop("__start")


def group_texts(df: DataFrame, key: Column, text: Column, order: Column, first: Sequence[str] = ()) -> DataFrame:
    """Per key the sorted distinct texts, and of the columns in ``first`` the value of the first row."""
    return df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(text)).alias("texts"), *(F.min_by(c, order).alias(c) for c in first))


def union_in_order(df: DataFrame, key: str, value: str, order: Sequence[str], name: str = "values") -> DataFrame:
    """Per key the distinct values in the order of their first row; repeats go before the shuffle, nulls are left out."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("__at"))
    lists = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", value))).alias("__all"))
    return lists.select(key, F.transform("__all", lambda x: x[value]).alias(name))
