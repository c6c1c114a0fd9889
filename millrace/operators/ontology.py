"""Ontology lookups, counts, trimming and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(word: Column, table: Column) -> Column:
    """Category of a word: itself, its plurals, and for longer words in s without one or two letters."""
    at = lambda w: F.try_element_at(table, w)
    cut = lambda n: F.when((F.length(word) > 3) & word.endswith("s"), at(F.substring(word, F.lit(1), F.length(word) - n)))
    return F.coalesce(at(word), at(F.concat(word, F.lit("s"))), at(F.concat(word, F.lit("es"))), cut(1), cut(2))


def invert(rows: DataFrame, last_wins: bool = True) -> DataFrame:
    """(word, category): of a word in several categories the last one counts, or the first."""
    pick = F.max_by if last_wins else F.min_by
    return rows.groupBy("word").agg(pick("category", "ord").alias("category"))


def conditional_share(pairs: DataFrame, least: int = 4, share: float = 0.6) -> DataFrame:
    """(word, category, n, share) from rows of (word, category): frequent words that mostly come with one category."""
    both = pairs.groupBy("word", "category").agg(F.count(F.lit(1)).alias("n"))
    both = both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("word")))
    return both.where((F.col("n") >= least) & (F.col("share") >= share))


def top_share(words: DataFrame, share: float) -> DataFrame:
    """(word, n): the most frequent ``share`` of the distinct words (ties: by word).

    The rank comes from counts of counts, so no task ranks all words; only
    the words of the count at the border are ranked.
    """
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    above = per.select("n", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"), "c")
    most = per.agg(F.floor(F.sum("c") * share).alias("most"))
    some = counts.join(above, "n").crossJoin(F.broadcast(most)).where("above < most")
    border = some.where("above + c > most").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("word"))).where("above + r <= most")
    return some.where("above + c <= most").select("word", "n").unionByName(border.select("word", "n"))


def trim(ontology: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(category, word, n): ontology words whose own or plural forms are frequent enough."""
    c = counts.select(F.col("word").alias("w"), "n")
    out = ontology
    for i, tail in enumerate(("", "s", "es")):
        out = out.join(c.select(F.col("w").alias(f"w{i}"), F.col("n").alias(f"n{i}")), F.concat("word", F.lit(tail)) == F.col(f"w{i}"), "left").drop(f"w{i}")
    return out.withColumn("n", F.coalesce("n0", "n1", "n2", F.lit(0))).where(F.col("n") >= least).select("category", "word", "n")


def closure(edges: DataFrame, roots: DataFrame, rounds: int = 20) -> DataFrame:
    """(root, node): nodes below the roots by (parent, child) edges, the roots too; level by level until nothing is new.

    Hierarchies are small dimensions; ``rounds`` bounds their depth.
    """
    seen = roots.select(F.col("node").alias("root"), "node").distinct()
    front = seen
    for _ in range(rounds):
        front = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        seen = seen.unionByName(front).checkpoint() if seen.sparkSession.sparkContext.getCheckpointDir() else seen.unionByName(front).cache()
        if front.isEmpty():
            return seen.distinct()
    raise ValueError("the hierarchy is deeper than the number of rounds")
