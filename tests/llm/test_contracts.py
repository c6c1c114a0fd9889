"""The registered queries on the driver's tables, against plain Python versions and held-out rows."""

import hashlib
import zlib
from collections import Counter

from brute_near import near
from pyspark.sql import functions as F

from millrace.llm import mixing, registry

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


def test_op2_against_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op2_near_join"](spark, SMALL).collect()}
    assert got == near(rows(spark, SMALL, "documents", "doc_id", "text"))


def test_op7_held_out_accuracy(spark):
    got = {r.doc_id: r for r in registry.queries()["op7_language"](spark, SF).collect()}
    docs = rows(spark, SF, "documents", "doc_id", "text", "lang")
    assert len(got) == len(docs)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 for d, _, _ in docs)
    assert all((got[d].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) for d, t, _ in docs)
    said = Counter((x, got[d].lang_pred == x) for d, t, x in docs if x is not None and got[d].held_out and got[d].lang_pred != "und")
    langs = {x for x, _ in said}
    assert len(langs) >= 4
    assert all(said[x, True] >= 0.97 * (said[x, True] + said[x, False]) for x in langs), said


def test_op10_digests(spark):
    got = {r.doc_id: r for r in registry.queries()["op10_ogg"](spark, SF).collect()}
    by_text = {}
    for d, text in rows(spark, SF, "documents", "doc_id", "text"):
        raw, r = (text or "").encode(), got[d]
        pad = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_mix_to_given_weights(spark):
    """At every slot up to the first gap each source is within less than one block of its share."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").alias("source"))
    weights, block = {"a": 5, "b": 3, "": 2}, 4
    got = mixing.mix_sources(df, weights=weights, block=block).collect()
    assert len({r.doc_id for r in got}) == len(got) == 3000
    served = {r.slot: r.source for r in got if r.in_mix}
    assert sorted(served) == list(range(len(served))) and len(served) > 100
    done = Counter()
    for slot in range(len(served)):
        done[served[slot]] += 1
        assert all(abs(done[s] - (slot + 1) * w / 10) < 1 for s, w in weights.items())
    assert len({(r.slot, r.pos) for r in got}) == 3000
