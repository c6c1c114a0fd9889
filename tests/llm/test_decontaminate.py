import random
import re

from millrace.llm.decontaminate import find_leaks

ITEM = "A farmer named Peter sells 12 kg of apples and 30 kg of pears at the market while Mary counts 12 boxes"
SAME = "Noise before it. a farmer named Peter sells 12 kg of apples and 30 kg of pears, at the market while Mary counts 12 boxes and more"
RESET = "Well, a farmer named Ivan sells 45 kg of apples and 8 kg of pears at the market while Zoe counts 45 boxes"
BROKEN = "Well, a farmer named Ivan sells 45 kg of apples and 8 kg of pears at the market while Zoe counts 77 boxes"


def test_templates_and_slots(spark):
    docs = spark.createDataFrame([(1, SAME, "x"), (2, RESET, "x"), (3, BROKEN, "x"), (4, "nothing to see here at all, not one thing of it", "x"), (5, None, "x"), (6, "", "x"), (7, SAME + " word" * 30000, "x")], "doc_id long, text string, hash string")
    items = spark.createDataFrame([(9, ITEM), (8, None), (7, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched_tokens, r.new_values) for r in find_leaks(docs, items).collect()}
    assert set(got) == {(1, 9), (2, 9), (7, 9)}
    assert got[1, 9][1] is False and got[2, 9][1] is True


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, SAME)], "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(docs.union(docs), items).count() == 1


def _found(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.matched_tokens, r.new_values) for r in find_leaks(docs, items).collect()}


def test_any_casing(spark):
    names = "Then Anna gave Ben two apples and 12 Pounds of plums before Carl asked for the rest of them"
    cased = [f(x) for x in (ITEM, names) for f in (str.upper, str.lower, str.title, str.swapcase)]
    got = _found(spark, cased, [ITEM, names])
    assert set(got) == {(i, i // 4) for i in range(8)}
    assert not any(new for _, new in got.values())


def test_edited_copies(spark):
    years = "the mill by the river was built in 1990 by two brothers and after the flood of 1990 it was sold to the town for a song"
    sums = "a clerk puts 3 red files on the shelf and 4 blue files under the desk before the office closes for the night"
    edited = years.replace("1990 it", "1991 it")
    merged = sums.replace("3", "5").replace("4", "5")
    got = _found(spark, [edited, merged], [years, sums])
    assert {(0, 0), (1, 1)} <= set(got)
    assert got[0, 0][1] is False and got[1, 1][1] is True


def test_short_items_match_as_a_whole(spark):
    items = ["How many moons does Mars have?", "yes", "What is 12 plus 7", "1 2 3 4 5 6 7 8 9 10", None, ""]
    docs = ["He asked me: how many moons does Venus have? I didn't know.", "HOW MANY MOONS DOES MARS HAVE?", "yes", "oh yes indeed", "tell me, what is 12 plus 7 now", "what is 30 plus 4", "so 1 2 3 4 5 6 7 8 9 10 it goes", "so 1 2 3 4 5 6 7 8 9 11 it goes", "how many moons", ""]
    got = _found(spark, docs, items)
    assert {k: new for k, (_, new) in got.items()} == {(0, 0): True, (1, 0): False, (2, 1): False, (4, 2): False, (6, 3): False}


def test_number_words(spark):
    words = ITEM.replace("12 kg", "twelve kg").replace("12 boxes", "twelve boxes")
    others = ITEM.replace("12 kg", "nine kg").replace("12 boxes", "nine boxes").replace("30 kg", "Forty kg")
    got = _found(spark, [words, others], [ITEM])
    assert {k: new for k, (_, new) in got.items()} == {(0, 0): False, (1, 0): True}


def brute(doc, item, window=8):
    """Whether a verbatim run of 13 words, or half the item, of windows of plain words is in the document."""
    words = lambda t: [w for w in re.split(r"[\W_]+", t.upper().lower()) if w]
    a, b = words(doc), words(item)
    best = 0
    for i in range(len(b)):
        for j in range(len(a)):
            n = 0
            while i + n < len(b) and j + n < len(a) and b[i + n] == a[j + n]:
                n += 1
            best = max(best, n)
    return best >= 13 or best >= max(window, len(b) / 2)


def test_verbatim_runs_against_brute_force(spark):
    r = random.Random(2)
    items = [" ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(r.randint(16, 30))) for _ in range(6)]
    docs = []
    for _ in range(60):
        w = r.choice(items).split()
        lo = r.randrange(len(w))
        docs.append(" ".join(["noise"] * r.randrange(9) + w[lo : lo + r.randrange(1, 30)] + ["end"] * r.randrange(9)))
    got = _found(spark, docs, items)
    assert set(got) == {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if brute(d, t)} and got


def test_null_keys_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, SAME, 1, 2), (None, None, 1, 2)], "doc_id long, text string, len int, __tok int")
    items = spark.createDataFrame([(None, ITEM, 1), (3, ITEM, 1)], "item_id long, text string, hash int")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} >= {(None, 3)}
