"""Golden cases of the caption, question and layout operators."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.models.settings import Settings
from millrace.operators import grouping, records, tensors
from millrace.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_pair_rules(spark):
    df = spark.createDataFrame([("actor in a hat.", "actress s hat -"), ("a dog by person", "the image by person"), ("a cat image", "cat"), ("x", "cat image")], "txt string, slug string")
    assert [tuple(r) for r in records.repair_pair(df).collect()][0] == ("actress in a hat", "actress 's hat")
    got = [tuple(r) for r in records.drop_suffixes(df).collect()]
    assert got[1:] == [("a dog", "the image"), ("a cat", "cat"), ("cat", "cat image")]


def test_gate_and_counts(spark):
    a = lambda x: F.lit(x)
    r = one(spark, records.answer_gate(a("yes"), a(1), ()), records.answer_gate(a("a boat"), a(1), ("black",)), records.people_answer(a("0")), records.people_answer(a("9")))
    assert tuple(r) == (False, True, "one person", "9")
    n = spark.range(3000).where(records.answer_gate(a("black"), F.col("id"), ("black",))).count()
    assert 850 < n < 1150


def test_person_questions(spark):
    ask = lambda t: records.person_questions(F.split(F.lit(t), " "), ("man", "person"), ("happy",), ("old",), ("hindu",), ("asian",))
    r = one(spark, ask("happy old man"), ask("man doctor"), ask("hindu doctor"))
    assert [tuple(x) for x in r[0]] == [("old man", "What is old man feeling?||happy"), ("old man", "How old is old man?||old"), ("man", "What gender is the person?||['man']")]
    assert r[1] == []
    assert [x["qa"] for x in r[2]] == ["What religion is person?||hindu"]


def test_defaults_maps_and_tokens(spark):
    answers = F.array(F.array(F.lit("a")), F.array().cast("array<string>"))
    r = one(spark, records.with_default_answers(answers, ("g",), F.array(F.lit("o"))), records.with_default_answers(answers, own=F.lit(None).cast("array<string>")), records.map_union(F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(2)), F.create_map(F.lit("k"), F.lit(3))))
    assert tuple(r) == (["a", "g", "o"], ["a"], {"k": 3, "l": 2})
    with pytest.raises(Exception, match="extra ids"):
        one(spark, records.special_tokens(F.array(F.lit("<extra_id_0>")), F.lit(2), F.lit(0)))


def test_layout_and_loss(spark):
    v = F.array(*map(F.lit, range(12)))
    logits = F.array(F.lit(1000.0), F.lit(1000.0))
    r = one(spark, tensors.permuted(v, (2, 3, 2), (1, 2, 0)), tensors.token_loss(logits, F.lit(1)), tensors.token_loss(logits, F.lit(-100)), tensors.group_norm(F.array(F.lit(1.0), F.lit(3.0)), 1, 2, 0.0))
    assert r[0] == [a * 6 + b * 2 + c for b in range(3) for c in range(2) for a in range(2)]
    assert math.isclose(r[1], math.log(2)) and r[2] == 0 and r[3] == [-1.0, 1.0]
    assert [x[0] for x in spark.range(1003).select(tensors.batch_of(F.col("id"), 500, True).alias("b")).groupBy("b").count().orderBy("b").select("count").collect()] == [501, 501, 1]


def test_tokenizer_files(spark, tmp_path):
    (tmp_path / "merges.txt").write_text("#version\na b\nab c\n")
    (tmp_path / "vocab.json").write_text('{"a": 0, "b\\"": 7}')
    assert [tuple(r) for r in readers.read_merges(spark, str(tmp_path / "merges.txt")).collect()] == [(0, "a b"), (1, "ab c")]
    assert {tuple(r) for r in readers.read_vocabulary(spark, str(tmp_path / "vocab.json")).collect()} == {("a", 0), ('b"', 7)}
    assert readers.merge_lines is not None and one(spark, readers.merge_lines(F.lit("x")))[0] == []


def test_union_in_order(spark):
    df = spark.createDataFrame([(1, 3, "b"), (1, 1, "c"), (1, 2, "b"), (1, 4, "a"), (1, 5, None), (2, 1, "z")], "k int, o int, v string")
    assert sorted(tuple(r) for r in grouping.union_in_order(df, "k", "v", ["o"]).collect()) == [(1, ["c", "b", "a"]), (2, ["z"])]
    assert grouping.union_in_order(df.limit(0), "k", "v", ["o"]).count() == 0


def test_settings(tmp_path):
    s = Settings({"model": {"heads": 8}, "a.b.c": 1})
    s["model.depth"] = 2
    assert s["model.heads"] == s["MODEL.HEADS"] == 8 and s["a"]["b.c"] == 1
    s.dump(tmp_path / "s.json")
    assert Settings.load(tmp_path / "s.json").to_dict() == {"model": {"heads": 8, "depth": 2}, "a": {"b": {"c": 1}}}
    with pytest.raises(KeyError):
        s["model.heads.x"] = 1
    with pytest.raises(KeyError):
        s["model.heads.x"]
