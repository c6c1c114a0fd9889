"""Stored indexes, sinks and readers that the queries don't reach."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus, grouping, qa
from millrace.sources import readers, sinks


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stored_lines_are_pruned(spark, tmp_path):
    d = spark.range(1000).select(F.col("id").alias("line_no"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    corpus.write_index(d, str(tmp_path / "i"), 4)
    stored = spark.read.parquet(str(tmp_path / "i"))
    got = corpus.lookup_list(stored, [7, 3, 7])
    assert sorted((r.pos, r.line) for r in got.collect()) == [(0, "line 7"), (1, "line 3"), (2, "line 7")]
    assert "In(line_no" in plan(got)
    part = corpus.lookup_range(stored, 10, 13)
    assert part.count() == 3 and "GreaterThanOrEqual(line_no" in plan(part)
    assert corpus.lookup_list(stored, []).count() == 0


def test_stored_terms_find_what_a_scan_finds(spark, tmp_path):
    texts = ["a dog and a cat", "a dog", "cat cat dog", "", None, "the dog saw the cat; the cat ran", "bird"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    corpus.write_terms(docs, "id", "text", str(tmp_path / "t"), 3)
    for wanted in (["dog", "cat"], ["cat"], ["dog", "whale"], ["bird"]):
        want = [tuple(r) for r in corpus.bm25(docs, "id", "text", wanted, 10).collect()]
        got = corpus.search_terms(spark, str(tmp_path / "t"), wanted, 10)
        assert [tuple(r) for r in got.collect()] == want
    assert "PushedFilters: [In(term" in plan(corpus.search_terms(spark, str(tmp_path / "t"), ["dog", "cat"], 10))


def test_grouped_lines_and_shards(spark, tmp_path):
    d = spark.createDataFrame([("k", ["u", "v"], 0), ("l", [], 5)], "k string, urls array<string>, row long")
    sinks.write_grouped(d.coalesce(1), str(tmp_path / "g"), "k", "urls")
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ["k\tu;#;v", "l\t"]
    sinks.write_shards(d, "row", 5, str(tmp_path / "s"))
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"0_4", "5_9"}


def test_sidecars_subsets_and_labels(spark, tmp_path):
    (tmp_path / "side" / "0").mkdir(parents=True)
    (tmp_path / "side" / "0" / "a.json").write_text('{"status": "success", "url": "u", "md5": "m"}')
    (tmp_path / "side" / "0" / "b.json").write_text('{"status": "failed", "url": "v", "md5": null}')
    assert [r.url for r in readers.read_sidecars(spark, str(tmp_path / "side")).collect()] == ["u"]
    (tmp_path / "r.json").write_text('[{"img_id": "3"}, {"img_id": "3"}, {"img_id": "4"}]')
    (tmp_path / "l.txt").write_text("5\n\n6\n")
    assert sorted(r.img_id for r in readers.read_subset(spark, str(tmp_path / "r.json"), "records").collect()) == [3, 4]
    assert sorted(r.img_id for r in readers.read_subset(spark, str(tmp_path / "l.txt"), "lines").collect()) == [5, 6]
    with pytest.raises(ValueError):
        readers.read_subset(spark, "x", "yaml")
    (tmp_path / "labels.txt").write_text("Dog,hound\ncat\n")
    assert sorted(tuple(r) for r in readers.read_labels(spark, str(tmp_path / "labels.txt")).collect()) == [(0, "dog"), (1, "cat")]
    r = spark.range(1).select(readers.hub_url("https://h/", F.lit("a/b"), "f").alias("a"), readers.hub_url("https://h", F.lit("b"), "f").alias("b")).first()
    assert tuple(r) == ("https://h/a/b/f", "https://h/b-f")


def test_bad_captions_raise(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tb\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_captions(spark, str(tmp_path / "c.tsv")).collect()


def test_group_texts_and_prompts(spark):
    d = spark.createDataFrame([("a", "y", 2, "second"), ("a", "x", 1, "first"), ("a", "y", 3, "third")], "k string, t string, o int, u string")
    r = grouping.group_texts(d, F.col("k"), F.col("t"), F.col("o"), ["u"]).first()
    assert (r.texts, r.u) == (["x", "y"], "first")
    p = spark.range(1).select(qa.prepend_input(F.lit("A"), F.lit("C")).alias("a"), qa.qa_prompt(F.lit("Q"), F.lit("C")).alias("b"), qa.e2e_prompt(F.lit("C")).alias("c"), qa.split_answers(F.lit("<pad> x<sep> <sep>y <sep> z")).alias("d")).first()
    assert tuple(p) == ("answer: A context: C", "question: Q  context: C", "generate questions: C", ["x", "y"])


def test_line_numbers_over_several_levels(spark):
    sizes = {d: d % 3 + 1 for d in range(-5, 60, 2)}
    d = spark.createDataFrame([(doc, p) for doc, n in sizes.items() for p in range(n)], "doc_id long, pos int")
    want = {(doc, p): i for i, (doc, p) in enumerate((doc, p) for doc in sorted(sizes) for p in range(sizes[doc]))}
    for step in (2, 3, 4096):
        assert {(r.doc_id, r.pos): r.line_no for r in corpus.number_lines(d, step=step).collect()} == want
    assert corpus.number_lines(d.limit(0)).count() == 0
