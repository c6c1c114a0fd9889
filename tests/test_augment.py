from pyspark.sql import functions as F

from millrace.functions.text import strs
from millrace.operators import augment as A


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_entities(spark):
    lists = [["", "big"], ["red"]]
    d = spark.range(60).select("id", A.augment_entities(F.lit("a dog saw a dog and a cat"), strs("dog", "cat", "dog", "cow"), F.col("id"), lists).alias("x"))
    rows = d.collect()
    assert rows == d.repartition(5).sortWithinPartitions("id").orderBy("id").collect()
    swapped = [r for r in rows if r.x.swaps]
    assert 15 < len(swapped) < 55
    for r in swapped:
        back = r.x.text
        for s in r.x.swaps:
            assert s.augmented.endswith("red " + s.plain) and back.count(s.augmented) == 1
            back = back.replace(s.augmented, s.plain, 1)
        assert back == "a dog saw a dog and a cat"


def test_pieces(spark):
    e = F.array(*(F.struct(F.lit(w).alias("element"), F.lit(s).alias("score")) for w, s in (("dog", 0.3), ("clock", 0.26), ("sun", 0.1))))
    assert value(spark, A.vetoed(e, strs("clock"), 0.21)) is True
    assert value(spark, A.vetoed(e, strs("sun"), 0.21)) is False
    assert [x.element for x in value(spark, A.kept_elements(e, strs("clock"), strs("sun"), 0.21))] == ["dog"]
    assert value(spark, A.drawable(e, F.slice(e, 3, 1), 0.21)) is False
    assert value(spark, A.distinct_by_prefix(strs("Flowers", "flower", "cat"))) == ["flower", "cat"]
    assert value(spark, A.prompt_prefix(F.lit("medical"), F.lit("photo"), F.lit(""))) == "A medical photo of"
    assert value(spark, A.longest_prefix(strs("a", "a photo", "zzz"), strs("a photo of it"))) == "a photo"
    assert value(spark, A.number_word(F.lit("2"))) == "two" and value(spark, A.number_word(F.lit("9"))) == "9"
    fits = lambda answer, text, *chunks: value(spark, A.answer_fits(F.lit("What does a cat eat?"), F.lit(answer), F.lit(text), F.array(*map(F.lit, chunks)).cast("array<string>")))
    assert fits("fish", "a cat sits", "a cat") is True and fits("fish", "a cat has fish", "a cat") is False
    assert fits("fish", "a cat has fish", "a cat", "a dog") is True and fits("fish", "a cat sits") is False
    assert fits("a cat", "it sits", "a dog") is False and fits("fish of the deep sea", "it", "a dog") is False and fits("", "it", "a dog") is False
    assert value(spark, A.repair_generated(F.lit("a lion in a tuxedo"), F.lit("a lion"), [("lion", "cat", "lion"), ("tuxedo", "suit", "tuxedo")])) == "a lion in a suit"
    assert value(spark, A.chance_swaps(F.lit(" he "), F.lit(1), [(1.0, [(" he ", " she ")])], [("she", "They")])) == " They "
    assert value(spark, A.implied_entities(strs("Cat", "the", "owl"), F.lit("a cat"), strs("the"))) == ["owl"]
    assert value(spark, A.distractors(F.lit("a clock"), ["x"], [("clock", "watch"), ("sun", "moon")])) == ["x", "moon"]
