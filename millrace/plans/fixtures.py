"""Inputs of the queries, derived from the driver's tables in both engines alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOUNS = ("dog", "cat", "horse", "oak tree", "guitar", "boat", "pizza", "bicycle", "teddy bear", "cathedral", "footballer", "roses", "automobile model", "body of water", "actor", "house")
PLACES = ("river", "old town", "stadium", "beach", "forest", "station", "flags", "museum", "label maker", "harbor")
HEADS = ("a photo of a", "the a big", "person and person with a", "person of person on a", "of with the", "map of a", "stock photo of a", "cartoon of a", "an in the", "during a")
TAILS = ("", "stock", "number id", "image", "by person", "- 4k", "id stock", "vector")

# Phrases that mark a caption to be left out, and ordered replacements.
IGNORE = (
    "confession bear", "white circle on", "concept showing a", "flag button series", "typography lettering phrase", "article list listillustrated country shape", "conceptual of a", "on the theme", "a sign for", "banner for", "map of", "maps of", "flag of", "flags of", "icon of", "icons of", "logo of", "logos of",
    "wallpaper", "pattern", "wallpapers", "flags", "icons", "patterns", "text message", "text messages", "label", "labels", "stylish text", "stamps", "stamp", "logologos3d", "shutterstock", "map showing",
)
REPLACE = (
    ("internet publishing and broadcasting and web search portals business", "internet"), ("automotive industry business", "car company"), ("advertising agencies business", "advertising agency"), ("medicinal and botanical manufacturing business", "a company"), ("manufacturing business", "a company"),
    ("bodies of water", "waters"), ("automobile model", "car"), ("a body of water", "the waters"), ("body of water", "waters"),
)
#: Phrases deleted from captions; longer lists are a parameter of the operators.
DELETE = ("stock photo of", "a photo of", "photo of", "cartoon of", "illustration of", "drawing of", "vector", "clipart", "royalty free", "close up of", "portrait of", "high resolution", "isolated on white background", "- 4k")

ONTOLOGY = {
    "animal": ("dog", "cat", "horse", "teddy bear"), "plant": ("oak tree", "rose", "tree"), "food": ("pizza", "apple", "bread"), "vehicle": ("boat", "bicycle", "car", "train"), "person": ("actor", "footballer", "singer"), "building": ("house", "cathedral", "stadium", "station", "museum"), "place": ("river", "beach", "forest", "harbor", "town"), "instrument": ("guitar", "piano"),
}
STOPWORDS = ("the", "a", "an", "of", "and", "to", "in", "is", "it", "that", "on", "with", "for", "as", "was", "be", "by", "at", "this", "are", "from")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ontology_rows() -> list[tuple[str, str, int]]:
    """(category, word, ord) in the order of the lists."""
    return [(c, w, i) for i, (c, w) in enumerate((c, w) for c, ws in ONTOLOGY.items() for w in ws)]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def local(spark: SparkSession, rows: Sequence[Sequence[object]], columns: str) -> DataFrame:
    """A small table made by the JVM from literals."""
    return spark.sql(f"SELECT * FROM VALUES {values(rows)} AS t({columns})")


def _pick(words: Sequence[str], by: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txt, url, idx) from part keys.

    The keys are dealt over all cores first: millions of them are one small
    file, which one task would read, while the rules for their captions take long.
    """
    k = F.col("p_partkey")
    keys = table(spark, sf_dir, "part").select(k).repartition(4 * spark.sparkContext.defaultParallelism, k)
    mid = F.concat(_pick(NOUNS, k), F.lit(" and a "), _pick(NOUNS, F.floor(k / 16)), F.lit(" near the "), _pick(PLACES, F.floor(k / 7)))
    txt = F.concat_ws(" ", _pick(HEADS, F.floor(k / 3)), mid, _pick(TAILS, F.floor(k / 5)))
    return keys.select(txt.alias("txt"), F.concat(F.lit("http://x.example.com/"), F.replace(mid, F.lit(" "), F.lit("-")), _pick(("-stock.jpg", "-12345.jpg?x=1", "_THE.png", "+of.jpg"), k)).alias("url"), k.alias("idx"))


def _sql_pick(words: Sequence[str], by: str) -> str:
    return f"({sql_list(words)})[({by}) % {len(words)} + 1]"


_MID = f"concat({_sql_pick(NOUNS, 'p_partkey')}, ' and a ', {_sql_pick(NOUNS, 'p_partkey // 16')}, ' near the ', {_sql_pick(PLACES, 'p_partkey // 7')})"
CAPTIONS = f"(SELECT concat_ws(' ', {_sql_pick(HEADS, 'p_partkey // 3')}, {_MID}, {_sql_pick(TAILS, 'p_partkey // 5')}) AS txt, concat('http://x.example.com/', replace({_MID}, ' ', '-'), {_sql_pick(('-stock.jpg', '-12345.jpg?x=1', '_THE.png', '+of.jpg'), 'p_partkey')}) AS url, p_partkey AS idx FROM part)"

#: Lines of documents: (doc_id, pos, line).
LINES = "(SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: Boxes from line items, an order being an image: (img, box, x1, y1, x2, y2, score).
BOXES = "(SELECT l_orderkey AS img, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS box, (l_partkey % 50)::DOUBLE AS x1, (l_suppkey % 50)::DOUBLE AS y1, l_partkey % 50 + 10 + l_quantity AS x2, l_suppkey % 50 + 10 + l_quantity AS y2, l_extendedprice AS score FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("img").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "img")
    return rows.select("img", F.row_number().over(by).cast("bigint").alias("box"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 10 + F.col("l_quantity")).alias("x2"), (y + 10 + F.col("l_quantity")).alias("y2"), F.col("l_extendedprice").alias("score"))
