import random
import string
import time

from brute_secrets import scan
from oracle import SF

from millrace.llm import secrets


def _spans(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    names = ("assign", "access", "hex", "entropy")
    return {r.doc_id: ",".join(f"{names[x.kind]}:{x.start}:{x.end}" for x in r.secrets) for r in secrets.find_secrets(d).collect()}


def test_registered_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = secrets.op5_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_entropy) == scan(texts[r.doc_id])
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0


def test_keys_beside_base_spans(spark):
    r = random.Random(8)
    key = "".join(r.choices(string.ascii_letters + string.digits, k=22)) + "G0123456789abcdefG" + "".join(r.choices(string.ascii_letters + string.digits, k=22))
    texts = [key, f"my_password={key}", f"database password: {key} and {key}", "deadbeef" * 4, "AKIA" + "QWERTYUIOPASDF12", "paſsword=abcdefghijkl", "toKen=abcdefghijkl"]
    got = _spans(spark, texts)
    assert got == {i: scan(t)[4] for i, t in enumerate(texts)}
    assert got[0] == "entropy:0:62,hex:23:39" and got[1] == "assign:3:74,hex:35:51"


def test_long_runs_in_linear_time(spark):
    r = random.Random(4)
    letters = "".join(r.choices(string.ascii_letters, k=999_999))
    texts = ["ab-12/" * 20000 + "+", letters[:500_000] + "7" + letters[500_000:], "password: " * 50000, letters]
    began = time.time()
    got = _spans(spark, texts)
    assert got[0] == "" and got[1] == "entropy:0:1000000" and got[2] == got[3] == ""
    assert time.time() - began < 90


def test_null_keys_and_ties(spark):
    d = spark.createDataFrame([(None, "token=abcdefghijklmnop"), (1, None), (1, None), (1, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, len(r.secrets)) for r in secrets.find_secrets(d).collect())
    assert got == [(False, 0)] * 3 + [(True, 1)]
