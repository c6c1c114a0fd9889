from pyspark.sql import functions as F

from millrace.streaming import ingest


def test_ingest_twice(spark, tmp_path):
    side = spark.createDataFrame([("success", "http://a/1", "m1"), ("success", "http://a/2", "m1"), ("failed", "http://a/3", "m3"), ("success", "http://a/4", "m4")], "status string, url string, md5 string")
    side.repartition(3).write.json(str(tmp_path / "in"))
    texts = spark.createDataFrame([("http://a/1", "old", 0), ("http://a/1", "one", 1), ("http://a/2", "two", 2), ("http://a/4", "four", 3)], "url string, text string, row_no int")
    go = lambda: ingest.run_ingest(spark, ingest.join_captions(ingest.sidecar_stream(spark, str(tmp_path / "in"), 1), texts), str(tmp_path / "out"), str(tmp_path / "log"))
    go()
    first = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.md5 for r in first.collect()) == ["m1", "m4"]
    spark.createDataFrame([("success", "http://a/2", "m2"), ("success", "http://a/4", "m9")], "status string, url string, md5 string").write.mode("append").json(str(tmp_path / "in"))
    go()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    assert len({r.url for r in rows}) == len({r.md5 for r in rows}) == len(rows)
    assert {r.md5 for r in rows} >= {"m1", "m4"} and "m9" not in {r.md5 for r in rows}


def test_deduplicated_is_streaming(spark, tmp_path):
    spark.createDataFrame([("success", "http://a/1", "m1")], "status string, url string, md5 string").write.json(str(tmp_path / "in"))
    s = ingest.deduplicated(ingest.sidecar_stream(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from dedup").count() == 1
    assert s.isStreaming and F


def test_pages_that_share_a_url_or_hash(spark, tmp_path):
    from oracle import connect

    from millrace.plans.flow_queries import ORACLES, QUERIES

    rows = [(1, "http://a/1", "x"), (2, "http://a/1", "y"), (3, "http://a/2", "y"), (4, "http://a/1", "z"), (5, "http://a/0", "z"), (6, "http://a/3", "x"), (7, "http://a/0", "w"), (8, "http://a/9", "x")]
    pages = spark.createDataFrame(rows + [(n, f"http://b/{n % 5}", f"t{n % 11}") for n in range(10, 60)] + [(None, "http://c", "c")], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = connect()
    c.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["stream_ingest"](spark, str(tmp_path)).select("url", "md5").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(ORACLES["stream_ingest"]).select("url, md5").fetchall())
