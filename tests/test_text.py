from pyspark.sql import functions as F

from millrace.functions import text as T


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_prompt_golden(spark):
    assert value(spark, T.normalise_prompt(F.lit("A Red Car  on the road at night :: 4k, HD —v2"))) == "a red car on the road at night 4k, hd"
    assert value(spark, T.normalise_prompt(F.lit("too short"))) is None
    assert value(spark, T.prompt_key(F.lit("a red car, on the road at night"))) == "aredcaronthero"


def test_keys(spark):
    assert value(spark, T.collapse_key(F.lit("The big cat, is here"))) == "thebigcather"
    assert value(spark, T.normalise_url(F.lit("HTTPS://A.com/x?u=http://b/C"))) == "http://b/c"
    assert value(spark, T.unquote(F.lit("a%20b+c"))) == "a b+c"
    assert value(spark, T.unquote(F.lit("100%"))) == "100%"


def test_prefixes(spark):
    p = lambda a, b: value(spark, T.shares_prefix(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")))
    assert p(["flowers"], ["flow"]) is True
    assert p(["cat"], ["cats"]) is False
    assert p([], ["cats"]) is False


def test_caption_words(spark):
    w = lambda t: value(spark, T.clean_words(F.lit(t)))
    assert w("the a dog and a cat") == ["a", "dog", "and", "a", "cat"]
    assert w("red car photo stock") == ["red", "car"]
    assert w("person and person walking in park") == ["people", "in", "park"]
    assert w("person of person walking in park") == ["walking", "in", "park"]
    assert w("of the") == ["the"]
    assert w("stock") == [] and w("") == []


def test_uniform_is_stable(spark):
    d = spark.range(100).select("id", T.uniform(F.col("id"), "s").alias("u"))
    assert {r.id: r.u for r in d.collect()} == {r.id: r.u for r in d.repartition(7).collect()}
    assert all(0 <= r.u < 1 for r in d.collect())


def test_replace_first(spark):
    assert value(spark, T.replace_first(F.lit("a b a"), F.lit("a"), F.lit("c"))) == "c b a"
    assert value(spark, T.replace_first(F.lit("b"), F.lit("a"), F.lit("c"))) == "b"
