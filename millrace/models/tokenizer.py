"""Byte-pair tokenising of texts with given vocabulary and merges, and sentinel ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_START = chr(ord(" ") + 256)


class BytePairs:
    """Lowest-rank merges of a word's characters, each word beginning with the start mark."""

    def __init__(self, vocab: Mapping[str, int], merges: Sequence[str], max_len: int = 64) -> None:
        self.vocab, self.max_len = dict(vocab), max_len
        self.rank = {tuple(m.split()): i for i, m in enumerate(merges)}
        self.pieces = lru_cache(65536)(self._pieces)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pieces"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.pieces = lru_cache(65536)(self._pieces)

    def _pieces(self, word: str) -> tuple[str, ...]:
        parts = [WORD_START, *word]
        while True:
            ranked = [(self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranked:
                return tuple(parts)
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def ids(self, text: str) -> list[int]:
        """Ids between the start and end marks, cut to ``max_len`` (the end mark too if it comes later)."""
        plain = text.lower().encode("ascii", "ignore").decode()
        unknown = self.vocab["<unk>"]
        body = [self.vocab.get(p, unknown) for w in plain.split(" ") if w for p in self.pieces(w)]
        return [self.vocab["<s>"], *body, self.vocab["</s>"]][: self.max_len]

    def rows(self, text: str, pad: int = 1) -> list[int]:
        """Two rows of ``max_len``: the first and last id, and all ids, both filled up."""
        ids = self.ids(text)
        head = [ids[0], ids[-1]]
        return head + [pad] * (self.max_len - 2) + ids + [pad] * (self.max_len - len(ids))

    def column(self, text: Column) -> Column:
        me = self

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            return texts.map(me.rows, na_action="ignore")

        return encode(text)


def sentinel_id(token: Column, vocab: int, visual: int = 100) -> Column:
    """Ids of numbered extra tokens, which count down from the vocabulary's end, the visual ones last."""
    n = F.regexp_extract(token, "_id_([0-9]+)>", 1).cast("int")
    return F.when(token.startswith("<vis_extra_id_"), vocab - 1 - n).when(token.startswith("<extra_id_"), vocab - 1 - visual - n)


def shift_right(ids: Column, start: int) -> Column:
    return F.concat(F.array(F.lit(start)), F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))


def padding_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def causal_mask(n: int) -> Column:
    i = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(i, lambda a: F.transform(i, lambda b: b <= a))
