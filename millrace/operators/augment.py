"""Sentence augmentation and record assembly, from given attribute lists, entities and scores.

Attribute lists, blocklists and swap ladders are parameters: they are data,
not code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, replace_first, strs, uniform


def attribute(key: Column, step: str, lists: Sequence[Sequence[str]], seed: int = 0) -> Column:
    """One word of each list, blanks left out, joined: the lists' repeats are weights."""
    drawn = [F.get(strs(*words), F.floor(uniform(key, f"{step}{i}", seed) * len(words)).cast("int")) for i, words in enumerate(lists)]
    return F.array_join(F.filter(F.array(*drawn), lambda w: w != ""), " ")


def augment_entities(text: Column, entities: Column, key: Column, lists: Sequence[Sequence[str]], chance: float = 0.33, seed: int = 0) -> Column:
    """(text, swaps) after each distinct entity has had its first occurrence augmented with the given chance.

    ``swaps`` is an array of (augmented, plain); each entity has draws of its
    own, by its place in the list.
    """
    start = F.struct(text.alias("text"), F.array().cast("array<struct<augmented:string,plain:string>>").alias("swaps"))
    marked = F.transform(F.array_distinct(entities), lambda e, i: F.struct(e.alias("e"), F.concat_ws(":", key.cast("string"), i.cast("string")).alias("k")))

    def step(acc: Column, x: Column) -> Column:
        words = F.trim(F.concat(attribute(x["k"], "attr", lists, seed), F.lit(" "), x["e"]))
        hit = (uniform(x["k"], "swap", seed) < chance) & F.contains(acc["text"], x["e"])
        swapped = lambda w: F.struct(replace_first(acc["text"], x["e"], w).alias("text"), F.array_append(acc["swaps"], F.struct(w.alias("augmented"), x["e"].alias("plain"))).alias("swaps"))
        return F.when(hit, let(words, swapped)).otherwise(acc)

    return F.aggregate(marked, start, step)


def chance_swaps(text: Column, key: Column, ladder: Sequence[tuple[float, Sequence[tuple[str, str]]]], repairs: Sequence[tuple[str, str]] = (), seed: int = 0) -> Column:
    """Ordered replacements, each rung of the ladder with its own chance, then the repairs."""
    for i, (chance, pairs) in enumerate(ladder):
        swapped = text
        for a, b in pairs:
            swapped = F.replace(swapped, F.lit(a), F.lit(b))
        text = F.when(uniform(key, f"rung{i}", seed) < chance, swapped).otherwise(text)
    for a, b in repairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def repair_generated(text: Column, source: Column, pairs: Sequence[tuple[str, str, str]]) -> Column:
    """Replaces words that a generator made up: (word, by, unless the source has this; empty: always)."""
    for word, by, unless in pairs:
        new = F.replace(text, F.lit(word), F.lit(by))
        text = new if not unless else F.when(F.contains(F.lower(source), F.lit(unless)), text).otherwise(new)
    return text


def prompt_prefix(genre: Column, picture: Column, mood: Column | None = None) -> Column:
    """``A <mood> <genre> <picture> of``, without the parts that are empty."""
    parts = [F.lit("A"), *([mood] if mood is not None else []), genre, picture, F.lit("of")]
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def longest_prefix(prefixes: Column, elements: Column) -> Column:
    """The longest of the prefix phrases that is found in one of the elements."""
    found = F.filter(prefixes, lambda p: F.exists(elements, lambda e: F.contains(e, p)))
    return F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


def distractors(text: Column, always: Sequence[str], unless: Sequence[tuple[str, str]]) -> Column:
    """Distractor words: those given always, and those whose trigger the text lacks."""
    return F.array_compact(F.array(*map(F.lit, always), *(F.when(~F.contains(text, F.lit(t)), F.lit(w)) for t, w in unless)))


def vetoed(elements: Column, distractor: Column, cutoff: float, high: float = 1.2) -> Column:
    """Whether a distractor scores at least the cutoff times ``high``; elements are (element, score)."""
    return F.exists(elements, lambda e: F.array_contains(distractor, e["element"]) & (e["score"] >= cutoff * high))


def drawable(patches: Column, boxes: Column, cutoff: float) -> Column:
    """Whether both the patches and the boxes have an element at the cutoff."""
    good = lambda side: F.exists(side, lambda e: e["score"] >= cutoff)
    return good(patches) & good(boxes)


def kept_elements(elements: Column, distractor: Column, implied: Column, cutoff: float, high: float = 1.2) -> Column:
    """Elements without distractors and without implied ones below the cutoff times ``high``."""
    return F.filter(elements, lambda e: ~F.array_contains(distractor, e["element"]) & (~F.array_contains(implied, e["element"]) | (e["score"] >= cutoff * high)))


def implied_entities(candidates: Column, text: Column, common: Column) -> Column:
    """Candidates that are neither in the text nor common words."""
    return F.filter(candidates, lambda c: ~F.contains(F.lower(text), F.lower(c)) & ~F.array_contains(common, F.lower(c)))


def distinct_by_prefix(entities: Column, n: int = 5) -> Column:
    """One entity per first ``n`` letters in lower case, the last one winning, in the order of first sight."""
    key = lambda e: F.left(F.lower(e), F.lit(n))
    keys = F.array_distinct(F.transform(entities, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(entities, lambda e: key(e) == k), -1))


def answer_fits(question: Column, answer: Column, text: Column, chunks: Column, most: int = 15) -> Column:
    """Whether an answer is short and not in its question, which has noun chunks, and it or one of those is new to the text."""
    new = F.exists(chunks, lambda c: ~F.contains(text, c))
    return (F.length(answer) <= most) & (answer != "") & ~F.contains(question, answer) & (F.size(chunks) > 0) & (~F.contains(text, answer) | new)


def number_word(n: Column) -> Column:
    """Words for the counts 0 to 5 (0 is told as one); other values stay."""
    words = F.create_map(*(F.lit(x) for kv in {"0": "one", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five"}.items() for x in kv))
    return F.coalesce(F.try_element_at(words, n), n)
