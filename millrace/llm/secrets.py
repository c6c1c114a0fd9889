"""Secret scans: known patterns, and strings of high sliding-window entropy.

Base kinds are found by pattern; spans are in code points, end exclusive.
The method's own kind, ``entropy``, takes maximal runs of key characters that
hold both a letter and a digit, and slides a window over them.  The counts of
the window's characters are kept up to date step by step, one slot changed for
the character that enters and one for the one that leaves, and with them
``sum(c * log2 c)`` in millionths, so that all arithmetic is exact.
A run is a secret if its highest window entropy reaches the threshold of its
character class (hex, alphanumeric, base64) and the allow list doesn't
suppress it.  An assignment found as a base span is blanked out before runs are
looked for, and a run that is an access key or a hex string as a whole is
covered already; a longer key with such a part in it is a span of its own,
beside the base span.

Everything is one projection of built-in functions: no shuffle, no Python.
The patterns have no nested repeats, so neither the stack nor the time grows
faster than a run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# a greedy run of at least n characters is the maximal run filtered by its length
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = (("hex", "^[0-9a-fA-F]+$", 3_000_000), ("alnum", "^[0-9A-Za-z]+$", 3_700_000), ("base64", "^.*$", 3_900_000))
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    "(?i)example|sample|dummy|placeholder|changeme|redacted",
)
#: A run is allowed too if each of its parts between separators is a word or a short number, the first one a word with a number perhaps.
SEPARATORS = "[-_/=]+"
ALLOWED_PART = "^([A-Za-z]+|[0-9]{1,8})$"
ALLOWED_FIRST = "^[A-Za-z]+[0-9]{1,8}$"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def xlogx(n: int) -> int:
    """n * log2 n in millionths."""
    return round(n * math.log2(n) * 1_000_000) if n else 0


def _pieces(text: Column, pattern: str, value_group: int = 0) -> Column:
    """The gaps between the leftmost non-overlapping matches, and each match (whole, and its group) after its gap."""
    p = F.lit(pattern)
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(value_group))
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.struct(pieces.alias("pieces"), F.element_at(gaps, -1).alias("rest"))


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose group has ``least`` characters, with the group; the pieces' lengths add up to the positions."""
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["whole"])
        span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(_pieces(text, pattern, value_group)["pieces"], start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.from_json(F.lit("[]"), _SPAN))


def _without_assigned(text: Column) -> Column:
    """The text with the assignments that are base spans blanked out, character for character."""
    cut = _pieces(text, ASSIGN, 2)
    kept = F.transform(cut["pieces"], lambda x: F.concat(x["gap"], F.when(F.length(x["value"]) >= ASSIGN_LEAST, F.repeat(F.lit(" "), F.length(x["whole"]))).otherwise(x["whole"])))
    return F.when(text.rlike(ASSIGN), F.concat(F.array_join(kept, ""), cut["rest"])).otherwise(text)


def lowest_sum(codes: Column, window: int = WINDOW) -> Column:
    """Least ``sum(c * log2 c)``, in millionths, over the windows of an array of character codes from 1 on.

    The counts are the characters of a string, one slot for each code, of
    which a step writes two: the character that enters the window counts one
    more, the one that leaves one less.
    """
    steps = F.array(*(F.lit(xlogx(n + 1) - xlogx(n)).cast("long") for n in range(window + 1)))
    start = F.struct(F.lit(" " * len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(2**62).cast("long").alias("low"))
    count = lambda n, code: F.ascii(F.substring(n, code, F.lit(1))) - ord(" ")
    write = lambda n, code, c: F.overlay(n, F.char(c + ord(" ")), code, 1)

    def moved(acc: Column, come: Column, go: Column) -> Column:
        entered = F.struct(write(acc["n"], come, count(acc["n"], come) + 1).alias("n"), (acc["s"] + F.get(steps, count(acc["n"], come))).alias("s"))
        left = F.when(go == 0, entered).otherwise(F.struct(write(entered["n"], go, count(acc["n"], go) - 1).alias("n"), (entered["s"] - F.get(steps, count(acc["n"], go) - 1)).alias("s")))
        return F.when(come == go, F.struct(acc["n"].alias("n"), acc["s"].alias("s"))).otherwise(left)

    def step(acc: Column, i: Column) -> Column:
        # a transform over one element binds a value that is used several times
        now = lambda m: F.struct(m["n"].alias("n"), m["s"].alias("s"), F.when(i >= window - 1, F.least(acc["low"], m["s"])).otherwise(acc["low"]).alias("low"))
        return F.get(F.transform(F.array(moved(acc, F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0)))), now), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["low"])


def _allowed(run: Column, patterns: Sequence[str]) -> Column:
    """Whether the allow list suppresses a run."""
    out = F.lit(False)
    for p in patterns:
        out = out | run.rlike(p)
    parts = F.filter(F.split(run, SEPARATORS), lambda x: x != "")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit("a"))
    return out | ((first.rlike(ALLOWED_PART) | first.rlike(ALLOWED_FIRST)) & F.forall(rest, lambda x: x.rlike(ALLOWED_PART)))


def find_secrets(df: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """``df``'s columns other than the text, with ``secrets``: an array of (start, kind, end, detail, entropy).

    Kinds are numbered assign 0, access 1, hex 2, entropy 3; for the last,
    ``detail`` is the character class and ``entropy`` the highest window
    entropy in millionths of a bit.  Null text counts as empty and gives an
    empty array; repeated rows give equal results; an empty table gives no
    rows.  Very long texts and runs are scanned whole, in time that grows with
    their length.  Spans that start together come in the order of their kinds,
    then ends.  Other columns, null or not, stay; an existing ``secrets`` is
    replaced.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (text, "secrets")]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = df.select(*keep, t.alias("__t")).select(
        *keep, F.concat(slim(_spans(F.col("__t"), ASSIGN, 0, 2, ASSIGN_LEAST)), slim(_spans(F.col("__t"), ACCESS, 1)), slim(_spans(F.col("__t"), HEX, 2))).alias("__base"), _spans(_without_assigned(F.col("__t")), CANDIDATE, 3).alias("__runs")
    )
    found = found.withColumn("__runs", F.filter("__runs", lambda r: r["value"].rlike("[A-Za-z]") & ~r["value"].rlike(f"^({ACCESS}|{HEX})$") & ~_allowed(r["value"], allowed)))

    def kind(run: Column) -> Column:
        out = F.when(run.rlike(CLASSES[0][1]), CLASSES[0][0])
        for name, pattern, _ in CLASSES[1:]:
            out = out.when(run.rlike(pattern), name)
        return out

    found = found.withColumn("__runs", F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), kind(r["value"]).alias("class"), F.transform(F.split(r["value"], ""), lambda c: F.instr(F.lit(ALPHABET), c)).alias("codes"))))
    full = xlogx(window)
    found = found.withColumn(
        "__runs", F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end"), r["class"].alias("detail"), F.floor((F.lit(full) - lowest_sum(r["codes"], window)) / window).alias("entropy")))
    )
    high = F.filter("__runs", lambda r: r["entropy"] >= _threshold(r["detail"]))
    base = F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("bigint").alias("entropy")))
    return found.select(*keep, F.array_sort(F.concat(base, high)).alias("secrets"))


def _threshold(name: Column, classes: Sequence[tuple[str, str, int]] = CLASSES) -> Column:
    out = F.when(name == classes[0][0], classes[0][2])
    for c, _, least in classes[1:]:
        out = out.when(name == c, least)
    return out.cast("long")


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*BASE_KINDS, "entropy")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_digest(F.filter("secrets", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _digest(F.col("secrets")).alias("spans"), count(3).alias("n_entropy")
    )


QUERIES = {"op5_secrets": op5_secrets}
ORACLES: dict[str, str] = {}
