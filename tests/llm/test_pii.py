import re
import time

from oracle import SF

from millrace.llm import pii


def slow_find(p, text):
    """All matches of all kinds against all found before, over the whole text at once."""
    found = []
    for name, pattern in pii._RE.items():
        kind = name.split("_")[0]
        for m in pattern.finditer(text):
            to = getattr(p, kind)(m[0])
            if to is not None and all(m.end() <= a or m.start() >= b for a, b, _, _ in found):
                found.append((m.start(), m.end(), kind, to))
    return sorted(found)


def test_registered_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    p = pii.Pseudonyms(pii.session_key(spark))
    rows, seen = pii.op6_pii(spark, SF).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        text, out, at = texts[r.doc_id] or "", [], 0
        found = slow_find(p, text)
        for a, b, _, to in found:
            out += [text[at:a], to]
            at = b
        assert (r.text or "") == "".join([*out, text[at:]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in found) for k in pii.KINDS]
        seen += len(found)
    assert seen


def test_long_texts_in_linear_time():
    p = pii.Pseudonyms(b"k")
    dates = " ".join(f"{2000 + i % 90}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(180_000))
    began = time.time()
    out, found = p.replace(dates)
    assert len(found) == 180_000 and len(out) == len(dates) and time.time() - began < 60
    assert len(p.made) <= p.MOST_KEPT


def test_the_key_is_the_sessions(spark):
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert key == pii.session_key(spark) and len(key) >= 32
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == b"mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_ties_null_keys_and_clashing_names(spark):
    d = spark.createDataFrame([(None, "4539578763621486", 1), (1, None, None), (1, None, None)], "doc_id long, text string, n_card int")
    got = sorted(pii.pseudonymise(d, b"k").collect(), key=lambda r: r.doc_id or 0)
    assert got[0].n_card == 1 and re.fullmatch("[0-9]{16}", got[0].text) and [r.text for r in got[1:]] == [None, None]
    assert got[0].n_phone == got[0].n_date == 0
