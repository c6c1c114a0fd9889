"""Readers and the name rules of the files they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTION_SCHEMA = "txt string, url string, idx string"
SIDECAR_SCHEMA = "status string, url string, md5 string"


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated captions; lines of another number of fields raise."""
    return spark.read.csv(path, sep="\t", quote="", schema=CAPTION_SCHEMA, mode="FAILFAST")


def read_laion(spark: SparkSession, path: str) -> DataFrame:
    """Header-less (gzip) TSV of text, keyword and URL; the keyword ``nan`` is empty, a bad URL is empty."""
    from ..functions.text import valid_url

    d = spark.read.csv(path, sep="\t", header=False, quote="", schema="text string, keyword string, url string")
    return d.select("text", F.when(F.col("keyword") == "nan", "").otherwise(F.col("keyword")).alias("keyword"), valid_url(F.coalesce("url", F.lit(""))).alias("url"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line): numbered lines of text files, gzip too, whole files as the unit of order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("l"))
    return files.select("file", F.posexplode("l").alias("pos", "line"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Successful sidecar records of a two-level folder."""
    return spark.read.schema(SIDECAR_SCHEMA).json(f"{path}/*/*.json").where("status = 'success'")


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(img_id, path, content) of binary files, the id from the file name."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select(file_id(F.element_at(F.split("path", "/"), -1)).alias("img_id"), "path", "content")


def read_subset(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(img_id): ids from JSON object keys, from a JSON list of records with img_id, or from lines."""
    if kind == "keys":
        d = spark.read.text(path, wholetext=True).select(F.explode(F.json_object_keys("value")).alias("img_id"))
    elif kind == "records":
        d = spark.read.schema("img_id string").json(path, multiLine=True)
    elif kind == "lines":
        d = spark.read.text(path).select(F.trim("value").alias("img_id")).where("img_id <> ''")
    else:
        raise ValueError(f"unknown kind of subset: {kind}")
    return d.select(F.col("img_id").cast("bigint").alias("img_id")).distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): one label a line, numbered from 0, the first synonym in lower case."""
    return read_lines(spark, path).select(F.col("pos").alias("id"), canonical_label(F.col("line")).alias("label"))


def canonical_label(t: Column) -> Column:
    return F.trim(F.lower(F.substring_index(t, ",", 1)))


def parse_record(t: Column, schema: str) -> Column:
    """A JSON record by its schema; null for blank or malformed text. Text is never evaluated."""
    return F.from_json(F.when(F.trim(t) != "", t), schema)


def file_id(name: Column) -> Column:
    """The number before the first full stop and after the last underscore."""
    return F.element_at(F.split(F.substring_index(name, ".", 1), "_"), -1).cast("int")


def is_remote(u: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def cache_name(u: Column, etag: Column | None = None) -> Column:
    """File name of a cached download: hash of the URL and, if given, of its tag; ``.h5`` is kept."""
    name = F.sha2(u, 256)
    if etag is not None:
        name = F.concat_ws(".", name, F.sha2(etag, 256))
    return F.when(u.endswith(".h5"), F.concat(name, F.lit(".h5"))).otherwise(name)


def hub_url(base: str, model: Column, file: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.when(F.contains(model, F.lit("/")), F.concat(model, F.lit(f"/{file}"))).otherwise(F.concat(model, F.lit(f"-{file}"))))


def merge_lines(t: Column) -> Column:
    """Merges of a file's text, by rank: its lines but the first, a heading, and the last, which is blank."""
    ls = F.split(t, "\n")
    return F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 2, F.lit(0)))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, merge) of a merges file, a bounded side file read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(merge_lines(F.col("value"))).alias("rank", "merge"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a JSON object of ids by token."""
    ids = F.from_json("value", "map<string,int>")
    return spark.read.text(path, wholetext=True).select(F.explode(ids).alias("token", "id"))
