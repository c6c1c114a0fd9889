"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, ranges, calendar).
Each valid value is permuted within its own format by a keyed Feistel
network: card numbers become other card numbers with a right check digit,
dates other dates in the same notation, and so on.  The permutation depends on
the key and the kind alone, so equal values keep equal pseudonyms in all
documents, and whoever holds the key can undo it.  A date is permuted as a
day, so that it stays linked across notations.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect, insort
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting with the key of the registered query.
KEY_SETTING = "spark.millrace.pii.key"
ROUNDS = 10
KINDS = ("email", "iban", "card", "ipv4", "date", "ssn", "phone")


class Feistel:
    """A keyed permutation of 0..n-1: alternating modular Feistel rounds on a rectangle, walking on until inside."""

    def __init__(self, n: int, key: bytes, tweak: str) -> None:
        self.n = n
        self.a = isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.keyed = hashlib.blake2b(tweak.encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.keyed, salt=i.to_bytes(2, "big"), digest_size=32).digest(), "big")

    def _once(self, v: int, undo: bool) -> int:
        left, right = divmod(v, self.b)
        for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            sign = -1 if undo else 1
            if i % 2:
                right = (right + sign * self._f(i, left)) % self.b
            else:
                left = (left + sign * self._f(i, right)) % self.a
        return left * self.b + right

    def __call__(self, v: int, undo: bool = False, ok: Callable[[int], bool] = lambda v: True) -> int:
        """The image of ``v``, among the values for which ``ok`` holds (as it must for ``v``)."""
        v = self._once(v, undo)
        while v >= self.n or not ok(v):
            v = self._once(v, undo)
        return v


def luhn_digit(body: str) -> str:
    """The check digit for the digits before it."""
    s = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-s % 10)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(shape: str, chars: str, pattern: str = "[0-9]") -> str:
    """``shape`` with the characters that match ``pattern`` replaced in turn by ``chars``."""
    it = iter(chars)
    return re.sub(pattern, lambda _: next(it), shape)


MONTHS = "January February March April May June July August September October November December".split()
_MONTH = {m[:k].lower(): i + 1 for i, m in enumerate(MONTHS) for k in (3, len(m))}
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "card_plain": r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}([/.-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([/.-])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[/.-][0-9])|(?<![0-9])(?:[0-9]{1,2} (?:MON)\.? [0-9]{4}|(?:MON)\.? [0-9]{1,2}, [0-9]{4})(?![0-9])".replace("MON", "|".join([*MONTHS, *(m[:3] for m in MONTHS)])),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
}
_RE = {k: re.compile(p) for k, p in PATTERNS.items()}
_NEAR = re.compile("[0-9]+|@")
_REACH = 80


class Pseudonyms:
    """Finds and permutes values of all kinds under one key."""

    #: Values and permutations kept at most, so that memory is bounded.
    MOST_KEPT = 20_000

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.nets: dict[tuple[int, str], Feistel] = {}
        self.made: dict[tuple[str, str, bool], str | None] = {}

    def net(self, n: int, kind: str) -> Feistel:
        f = self.nets.get((n, kind))
        if f is None:
            f = self.nets[n, kind] = Feistel(n, self.key, f"{kind}/{n}")
        return f

    def _digits(self, d: str, kind: str, undo: bool, ok: Callable[[str], bool] = lambda d: True) -> str:
        w = len(d)
        return str(self.net(10**w, kind)(int(d), undo, lambda v: ok(str(v).zfill(w)))).zfill(w)

    def _mixed(self, s: str, kind: str, undo: bool) -> str:
        """Digits to digits, lower and upper case letters to their own kind; other characters stay."""
        base = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        low = [ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A") if c.isalpha() else ord(c) for c in s]
        n = v = 1
        for c, b, o in zip(s, base, low, strict=True):
            n, v = n * b, (v - 1) * b + ord(c) - o + 1 if b > 1 else v
        if n < 2:
            return s
        shape = "".join(f"{b}," for b in base)
        v = self.net(n, f"{kind}/{shape}")(v - 1, undo)
        out = []
        for b, o in zip(reversed(base), reversed(low), strict=True):
            v, r = divmod(v, b)
            out.append(chr(o + r))
        return "".join(reversed(out))

    def email(self, s: str, undo: bool = False) -> str | None:
        local, _, host = s.rpartition("@")
        return f"{self._mixed(local, 'email', undo)}@{host}"

    def iban(self, s: str, undo: bool = False) -> str | None:
        t = s.replace(" ", "")
        if not 15 <= len(t) <= 34 or _iban_rest(t) != 1:
            return None
        body = self._mixed(t[4:], "iban" + t[:2], undo)
        check = 98 - _iban_rest(t[:2] + "00" + body)
        return refill(s, f"{t[:2]}{check:02d}{body}", "[A-Z0-9]")

    def card(self, s: str, undo: bool = False) -> str | None:
        d = re.sub("[ -]", "", s)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = self._digits(d[:-1], "card", undo, lambda b: len(set(b + luhn_digit(b))) > 1)
        return refill(s, body + luhn_digit(body))

    def ipv4(self, s: str, undo: bool = False) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        return str(ipaddress.IPv4Address(self.net(2**32, "ipv4")(int(ipaddress.IPv4Address(s)), undo)))

    def date(self, s: str, undo: bool = False) -> str | None:
        """Slashed dates are month first if they can be, dotted and dashed ones day first if they can be.

        Where the other order was told only by a day over 12, the pseudonym
        has such a day too, so that it is read in the same order.
        """
        name = re.search("[A-Z][a-z]+", s)
        numbers = re.findall("[0-9]+", s)
        day_first = clear = False
        if name:
            day, year = map(int, numbers)
            month = _MONTH[name[0].lower()]
        elif len(numbers[0]) == 4:
            year, month, day = map(int, numbers)
        else:
            one, two, year = map(int, numbers)
            day_first = one > 12 if "/" in s else two <= 12
            clear = day_first == ("/" in s)
            day, month = (one, two) if day_first else (two, one)
        try:
            ordinal = dt.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            return None
        ok = lambda v: not clear or dt.date.fromordinal(FIRST_DAY + v).day > 12
        d = dt.date.fromordinal(FIRST_DAY + self.net(LAST_DAY - FIRST_DAY + 1, "date")(ordinal - FIRST_DAY, undo, ok))
        if name:
            full = MONTHS[d.month - 1]
            out = re.sub("[0-9]+", lambda _, it=iter([str(d.day).zfill(2 if numbers[0][0] == "0" else 1), str(d.year)]): next(it), s)
            return out.replace(name[0], full if len(name[0]) > 3 or name[0] == "May" else full[:3])
        order = [d.year, d.month, d.day] if len(numbers[0]) == 4 else [d.day, d.month, d.year] if day_first else [d.month, d.day, d.year]
        wide = all(len(x) > 1 for x in numbers) or any(x[0] == "0" for x in numbers)
        return re.sub("[0-9]+", lambda _, it=iter(order): str(next(it)).zfill(2 if wide else 1), s)

    def ssn(self, s: str, undo: bool = False) -> str | None:
        ok = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = s.replace("-", "")
        return refill(s, self._digits(d, "ssn", undo, ok)) if ok(d) else None

    def phone(self, s: str, undo: bool = False) -> str | None:
        code = re.match(r"\+([0-9]{1,3})(?=[ .(-])|\+[0-9]", s)
        at = code.end() if code else 0
        d = re.sub("[^0-9]", "", s[at:])
        if not 7 <= len(d) <= 13:
            return None
        return s[:at] + refill(s[at:], self._digits(d, "phone" + (code[0] if code else ""), undo))

    def of(self, kind: str, s: str, undo: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't valid."""
        if (kind, s, undo) not in self.made:
            if len(self.made) >= self.MOST_KEPT:
                self.made.clear()
            if len(self.nets) >= self.MOST_KEPT:
                self.nets.clear()
            self.made[kind, s, undo] = getattr(self, kind)(s, undo)
        return self.made[kind, s, undo]

    def windows(self, text: str) -> Iterator[tuple[int, int]]:
        """Stretches of a text that can hold a value: around digits and at signs."""
        lo = hi = -1
        for m in _NEAR.finditer(text):
            a, b = max(0, m.start() - _REACH), m.end() + (256 if m[0] == "@" else _REACH)
            if lo >= 0 and a <= hi:
                hi = max(hi, b)
                continue
            if lo >= 0:
                yield lo, min(hi, len(text))
            lo, hi = a, b
        if lo >= 0:
            yield lo, min(hi, len(text))

    def find(self, text: str, undo: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), not overlapping; earlier kinds first where they would."""
        found: list[tuple[int, int, str, str]] = []
        for lo, hi in self.windows(text):
            own: list[tuple[int, int, str, str]] = []
            for name, pattern in _RE.items():
                kind = name.split("_")[0]
                if kind == "email" and text.find("@", lo, hi) < 0:
                    continue
                for m in pattern.finditer(text, lo, hi):
                    # those found are sorted and apart, so only the neighbours of a new one can overlap it
                    at = bisect(own, (m.start(),))
                    free = (at == 0 or own[at - 1][1] <= m.start()) and (at == len(own) or own[at][0] >= m.end())
                    if free and (to := self.of(kind, m[0], undo)) is not None:
                        insort(own, (m.start(), m.end(), kind, to))
            found += own
        return found

    def replace(self, text: str, undo: bool = False) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.find(text, undo)
        out, at = [], 0
        for a, b, _, to in found:
            out += [text[at:a], to]
            at = b
        return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.millrace.pii.key``; where it is unset, a random one is put there, which holds as long as the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def pseudonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``df`` with the values in ``text`` replaced, and an ``n_<kind>`` long for each kind (existing ones are replaced).

    Null text stays null with zero counts; empty and very long texts are
    handled whole, in time that grows with their length; equal values get equal
    pseudonyms in every row, repeated ones too.  Where kinds meet in a place,
    the one listed first in ``PATTERNS`` has it.  An empty table gives no rows.
    Other columns, null or not, stay.  Nothing is shuffled.
    """
    made = [f"n_{k}" for k in KINDS]
    keep = [c for c in df.columns if c not in made and c != text]
    src = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for b in batches:
            texts, counts = [], []
            for v in b.column(len(keep)):
                t = v.as_py()
                out, found = p.replace(t) if t else (t, [])
                texts.append(out)
                counts.append([sum(x[2] == k for x in found) for k in KINDS])
            cols = list(zip(*counts, strict=True)) if counts else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, text, *made])

    fields = [f"`{c}` {k}" for c, k in src.dtypes if c != "__text"] + [f"`{text}` string"] + [f"{c} bigint" for c in made]
    return src.mapInArrow(run, ", ".join(fields)).select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *made)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
