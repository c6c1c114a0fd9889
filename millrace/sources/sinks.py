"""Writers for the formats that corpora are exchanged in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_MARK = ";#;"


def group_line(*columns: Column) -> Column:
    """One tab-separated line; arrays are joined by the list mark."""
    return F.concat_ws("\t", *(F.concat_ws(LIST_MARK, c) for c in columns))


def write_sorted_gzip(df: DataFrame, column: str, path: str) -> None:
    """Sorted lines as gzip text; the sort is by range, so the files in name order are sorted as a whole."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.option("compression", "gzip").text(path)


def write_grouped(df: DataFrame, path: str, *columns: str) -> None:
    df.select(group_line(*(F.col(c).cast("array<string>") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def write_shards(df: DataFrame, row: str, size: int, path: str) -> None:
    """Caption shards of ``size`` rows, each in a folder named after its first and last row."""
    start = F.floor(F.col(row) / size) * size
    df.withColumn("shard", F.concat_ws("_", start.cast("string"), (start + size - 1).cast("string"))).write.partitionBy("shard").parquet(path)


def upsert_vectors(old: DataFrame | None, new: DataFrame, row: str = "row_idx", batch: str = "batch_id") -> DataFrame:
    """Dense rows by index; a later batch's row takes the place of an earlier one."""
    rows = new if old is None else old.unionByName(new)
    keep = [c for c in rows.columns if c not in (row, batch)]
    return rows.groupBy(row).agg(F.max(batch).alias(batch), *(F.max_by(c, batch).alias(c) for c in keep))
