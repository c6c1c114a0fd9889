from brute_near import near
from oracle import SF
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from millrace.llm import decontaminate, mixing, quality, sharding


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r.doc_id: r.text for r in quality.grade(docs, model).collect() if (r.p_top or 0) >= quality.KEEP_TAIL}
    one = {k for k, (_, c) in near(good.items()).items() if k == c}
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    table = sharding.fill_table(sharding.SHARDS)
    want = {k: table[int(__import__("hashlib").md5(str(k).encode()).hexdigest()[:15], 16) % len(table)] for k in one - leaks}
    assert {r.doc_id: r.shard for r in got.collect()} == want
    assert all(rows[r.doc_id] == r.text for r in got.collect())
    assert mixing.BLOCK > 0 and len(pipeline.STAGES) == 5


def test_stages_take_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", None, 0, "x"), (None, "a b c d e f", None, "s", 3, "x"), (2, "", "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, "word " * 30000, "en", "s", 9, "x")], "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, table, SF)
            assert sorted(out.columns) == sorted(docs.columns)
            assert out.count() <= table.count()
            if k == 3:
                assert out.count() == table.count()


def test_appended_text_is_near(spark):
    words = [f"w{i}" for i in range(100)]
    copy = [*words, *(f"x{i}" for i in range(20))]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(copy), "en", "s", 0), (3, " ".join(copy[30:]), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.keep_one_of_near(spark, docs, SF).collect()) == [1, 3]


def test_shards_are_in_mixed_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = pipeline.run(spark, SF)
        at = {r.doc_id: (r.slot, r.pos) for r in mixing.mix_sources(got).collect()}
        rows = [(r.shard, at[r.doc_id]) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 100 and rows == sorted(rows)


def test_mix_decides_the_order_in_shards(spark, tmp_path, monkeypatch):
    other = lambda spark, docs, sf_dir: docs.orderBy(F.col("doc_id").desc())
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', repeat('x', cast(id % 50 AS int))) AS text", "'en' AS lang", "concat('s', id % 3) AS source", "id AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pipeline, "STAGES", [("mixing_sources", other), ("sharding", pipeline.shard)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(r.shard, r.doc_id) for r in pipeline.run(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 2000 and rows == sorted(rows, key=lambda x: (x[0], -x[1]))


def test_order_of_rows_that_are_no_files(spark):
    docs = spark.range(500).selectExpr("499 - id AS doc_id", "'a' AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    rows = [(r.shard, r.doc_id) for r in pipeline.shard(spark, docs, SF).collect()]
    assert len(rows) == 500 and rows == sorted(rows, key=lambda x: (x[0], -x[1]))
