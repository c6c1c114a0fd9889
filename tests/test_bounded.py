"""Steps whose largest task doesn't follow the table."""
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import corpus, rewrite
from millrace.plans import fixtures


def test_a_frequent_term_goes_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILE_WORDS", 500)
    docs = spark.range(2000).select("id", F.concat(F.lit("the the "), F.when(F.col("id") % 50 == 0, "dog").otherwise("cat")).alias("text"))
    corpus.write_terms(docs, "id", "text", str(tmp_path / "t"), 2)
    rows = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "t" / "terms").glob("*.parquet")]
    assert sum(rows) == 4000 and len(rows) >= 8 and max(rows) <= 1000
    for wanted in (["the", "dog"], ["cat"]):
        want = [tuple(r) for r in corpus.bm25(docs, "id", "text", wanted, 30).collect()]
        assert [tuple(r) for r in corpus.search_terms(spark, str(tmp_path / "t"), wanted, 30).collect()] == want


def test_stored_lines_grow_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILE_BYTES", 1000)
    corpus.write_index(spark.range(1000).select(F.col("id").alias("line_no"), F.lit("0123456789").alias("line")), str(tmp_path / "i"), 2)
    assert len(list((tmp_path / "i").glob("*.parquet"))) >= 8 and spark.read.parquet(str(tmp_path / "i")).count() == 1000


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(rewrite, "CHUNK_ROWS", 3)
    long = "A sentence of some words here. " * 60
    rows = [(1, long), (2, None), (3, ""), (4, long + "x" * 400), (5, "short"), (6, long)] * 3
    df = spark.createDataFrame([(k * 10 + n, t) for n, (k, t) in enumerate(rows)], "k int, t string")
    got = rewrite.chunks(df.coalesce(1), "k", "t")
    assert got.schema.simpleString() == "struct<k:int,chunk_no:int,chunk:string>"
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    want = [(k * 10 + n, i, c) for n, (k, t) in enumerate(rows) if t for i, c in enumerate(rewrite.chunk_text(t))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_captions_of_one_file_are_dealt_over_cores(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array(range(4000), pa.int64())}), str(tmp_path / "part.parquet"))
    c = fixtures.captions(spark, str(tmp_path))
    dealt = [r.n for r in c.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(dealt) == 4000 and len(dealt) >= spark.sparkContext.defaultParallelism and max(dealt) < 1000


def test_phrases_are_tested_on_a_value_worked_out_once(spark):
    d = spark.createDataFrame([("a dog map of x",), ("map",), ("xmap of",), (" map of",), (None,), ("flag map of a flag ",)], "t string")
    plan = d.where(T.has_phrase(F.concat(F.lower("t"), F.lit("")), ["map of", "flag", "wallpaper"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t") == 1 and "concat(lambda" not in plan
    got = d.select(T.has_phrase(F.col("t"), ["map of", "flag"]), T.delete_phrases(F.col("t"), ["map of", "flag"])).collect()
    assert [tuple(r) for r in got] == [(True, "a dog x"), (False, "map"), (False, "xmap of"), (True, ""), (None, None), (True, "a ")]
