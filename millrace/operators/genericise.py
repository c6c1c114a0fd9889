"""Generic captions for those that say no more than their slug.

The rules of ``rewrite.OntologyRewriter``, further ones for possessives,
superlatives and uncountable categories, and loose adjectives dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrite import ALIAS_ENDS, ALIAS_WORDS, ARTICLES, LabelRepair, OntologyRewriter

# Word classes of the rules.
OWNERS = ("their", "our", "your", "his", "her", "its", "my", "'s")
UNCOUNTABLE = ("waters", "clothes", "food", "kitchenware", "military")
OPENERS = ("with", "of", "on", "in", "during", "at", "by", "a", "an", "this", "that", "some", "the", "all", "other", "another", "those", "their", "our", "your", "his", "her", "'s", "its", "my")
SUPERLATIVES = ("least", "most")
LISTING = ("and", "or", ",")
BODY = ("hand", "feet", "foot", "wrist", "face", "ear", "hair", "nose", "back", "leg", "arm", "legs", "arms", "chest", "eye", "eyes")
HOLDERS = ("my", "your", "our", "their")
BEFORE_ADJECTIVE = ("and", "or", ",", "look", "looks", "looked", "most")
DESCRIPTOR_ENDS = ("ed", "ing", "es", "ous")
ADJECTIVE_ENDS = ("al", "less", "able", "ful", "ly")
PLURAL_ARTICLE = {"a": "the", "an": "the", "another": "other"}

_near = LabelRepair.meets


@dataclass(frozen=True)
class Genericiser(OntologyRewriter):
    """``OntologyRewriter`` with the rules of captions that equal their slug."""

    def weak(self, word: str) -> bool:
        return len(word) < 3 or word in self.stopwords or word.endswith(DESCRIPTOR_ENDS + ADJECTIVE_ENDS)

    def split(self, text: str) -> list[str]:
        for mark, apart in (("'s ", " 's "), (",", " , "), ("-", " - "), (":", " : "), ("- -", "--")):
            text = text.replace(mark, apart)
        # a comma after a digit stays with it; the fixed rule for 1 leaves a blank before the comma
        text = re.sub("([02-9]) , ", r"\1,", text).replace("1 , ", "1 ,")
        return text.lower().split()

    def generic(self, words: list[str]) -> list[str]:
        """Words of over three letters by their categories, but persons that someone has; plurals stay plural."""
        out = list(words)
        for i, word in enumerate(words):
            stems = [word] + ([word[:-1], word[:-2]] if len(word) > 3 and word.endswith("s") else [])
            base = next((s for s in stems if s in self.categories), None)
            if base is None or base in self.keep or len(word) <= 3:
                continue
            category = self.categories[base]
            if category == "person" and i > 0 and _near(out[max(0, i - 2) : i], OWNERS):
                continue
            out[i] = category if base == word else self.plural(category)
        return out

    def plural(self, category: str) -> str:
        return category if category in UNCOUNTABLE else self.person_plural.get(category, category + "s")

    def one_pass(self, words: list[str]) -> tuple[list[str], bool]:
        w, seen, changed = list(words), set(), False
        for i, word in enumerate(w):
            own = self.category(word)
            changed |= own is not None and self._alias(w, i, own)
            changed |= own is not None and self._bare(w, i)
            own, merged = self._merge(w, i, word, own)
            changed |= merged
            if i > 0:
                changed |= self._article(w, i, word, own, seen)
                changed |= self._number(w, i, word)
            if own is not None:
                seen.add(word)
            elif self._loose(w, i, word):
                w[i], changed = "", True
        return [x for x in w if x], changed

    def _alias(self, w: list[str], i: int, own: str) -> bool:
        """``Y known as X``, both of a category: X stays."""
        if i <= 3 or not (tuple(w[i - 2 : i]) in ALIAS_ENDS or w[i - 1] in ALIAS_WORDS):
            return False
        return self._blank_from(w, i, self._same(own, w[i - 3 : i - 1])) is not None

    @staticmethod
    def _blank_from(w: list[str], i: int, found: int | None) -> int | None:
        """Blanks the words from the found one (counted from three before ``i``) up to ``i``; its place."""
        if found is None:
            return None
        at = max(0, i - 3) + found
        w[at:i] = [""] * (i - at)
        return at

    def _bare(self, w: list[str], i: int) -> bool:
        """The descriptor before a generic word goes, at the beginning or after an opening word, but for superlatives."""
        if i == 0:
            return False
        before = w[max(0, i - 3) : i - 1]
        opened = i <= 2 or _near(before, OPENERS)
        descriptor = w[i - 1]
        if not opened or set(before) & set(SUPERLATIVES) or len(descriptor) < 3 or descriptor in self.stopwords or descriptor.endswith(DESCRIPTOR_ENDS):
            return False
        w[i - 1] = ""
        return True

    def _merge(self, w: list[str], i: int, word: str, own: str | None) -> tuple[str | None, bool]:
        """``X and (a) X`` as a plural; (category, changed), the category being the word itself where one was looked for."""
        if i < 2 or (own is None and self.weak(word)):
            return own, False
        before = w[i - 1]
        apart = before in ARTICLES and i > 2 and w[i - 2] in LISTING
        alike = before not in ARTICLES and before not in LISTING and self.category(before) == own
        if not (apart or before in LISTING or alike):
            return own, False
        link, target = w[i - 2] if apart else before, own or word
        at = self._blank_from(w, i, self._same(target, w[max(0, i - 3) : i]))
        if at is None:
            return target, False
        if link in ("and", "or") and i > 3 and w[at - 1] == ",":
            w[at - 1] = link
        if target not in UNCOUNTABLE:
            w[i] = self.plural(target)
        article = next((k for k in (i - 3, i - 4) if k >= 0 and w[k] in ("a", "an")), None)
        if article is not None:
            w[article] = "the"
        return target, True

    @staticmethod
    def _article(w: list[str], i: int, word: str, own: str | None, seen: set[str]) -> bool:
        old = w[i - 1]
        if old in ("a", "an"):
            w[i - 1] = "another" if {word, word + "s", word + "es"} & seen else "an" if word[0] in "aeiou" else "a"
        elif old in HOLDERS and own not in ("person", "people") and not _near([word], BODY):
            w[i - 1] = "the"
        return w[i - 1] != old

    @staticmethod
    def _number(w: list[str], i: int, word: str) -> bool:
        """No singular article before a plural, right before it or with a short word between."""
        if not (word in UNCOUNTABLE or word == "people" or word.endswith("s")):
            return False
        at = i - 1 if w[i - 1] in PLURAL_ARTICLE else i - 2 if i > 1 and len(w[i - 1]) < 4 and w[i - 2] in PLURAL_ARTICLE else None
        if at is not None:
            w[at] = PLURAL_ARTICLE[w[at]]
        return at is not None

    def _loose(self, w: list[str], i: int, word: str) -> bool:
        return len(word) > 4 and word not in self.stopwords and word.endswith(ADJECTIVE_ENDS) and (i == 0 or w[i - 1] not in BEFORE_ADJECTIVE)


def generic_pairs(df: DataFrame, rules: Genericiser, txt: str, slug: str) -> DataFrame:
    """``df`` where a caption that equals its slug has its generic form in the slug's place; other rows don't leave the JVM's values.

    Both are stripped of points, commas and blanks where they then differ.
    """

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(rules, na_action="ignore")

    t, s = F.col(txt), F.col(slug)
    same = F.coalesce(t == s, F.lit(False))
    strip = lambda c: F.btrim(c, F.lit("., "))
    out = df.withColumn("__generic", rewrite(F.when(same, s)))
    g: Column = F.col("__generic")
    differs = same & (g != s)
    return out.withColumns({txt: F.when(differs, strip(t)).otherwise(t), slug: F.when(differs, strip(g)).otherwise(s)}).drop("__generic")
