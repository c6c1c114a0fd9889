"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens in which numbers, names (capitalised
words inside a sentence) and units (unit words after a number) are typed
placeholders that keep their value as a slot.  Windows of ``WINDOW`` tokens
are hashed and joined with those of the benchmark's items.  Windows that hit
an item on the same diagonal (position in the document minus position in the
item) belong together; their slots must be consistent: each of the item's
values stands for one value of the document, and the reverse.  So a question
is caught with other numbers and names in it, while a chance meeting of
templates is not.  What is a name hangs on capital letters, so windows in
which only numbers and units are placeholders, and names are words whatever
their case, are joined as well.  Where the slots of a diagonal aren't
one-to-one, its windows without a clash are kept; several values of an item
may share one of the document.  Number words are numbers.

Items of fewer than ``WINDOW`` tokens, and items of which no window has
``LEAST_LITERAL`` literal tokens, match as a whole: all their tokens, and word
for word where fewer than ``LEAST_LITERAL`` of them are literals; one of fewer
than ``LEAST_ALONE`` tokens only a document that is nothing else.

Only built-in functions are used.  Every window holds one of the groups of
``GRAM`` tokens that start at each ``GRAM``-th token, so only windows round
groups that the benchmark has too are worked out, and held against a bitmap of
the benchmark's windows before they leave their row.  The bitmaps grow with the
benchmark; beyond their bound more windows pass, and results stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_join import stored

WINDOW = 8
GRAM = 4
#: Shorter items match whole documents alone.
LEAST_ALONE = 4
#: Tokens of an item that a document must repeat on one diagonal, or this share of a shorter item.
LEAST_TOKENS = 13
LEAST_SHARE = 0.5
#: Tokens of a window that must not be placeholders.
LEAST_LITERAL = WINDOW // 2
#: Bits of a bitmap, as powers of two: sixty-four an entry, between these bounds.
BITMAP_BITS = (20, 24)
#: Windows of the benchmark up to which the join broadcasts them; beyond, it shuffles.
MOST_BROADCAST = 50_000

NAME_MARK, UNIT_MARK = "", ""
# Unit words and signs.
UNITS = "percent|pounds|pound|kilograms|kilogram|grams|gram|miles|mile|metres|metre|meters|meter|inches|inch|feet|foot|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|liters|liter|litres|litre|degrees|degree|kmh|km|cm|mm|kg|mg|ml|lb|oz|ft|kwh|kw|mph|usd|eur|gb|mb|kb"
# Number words, by what they are in digits.
NUMBERS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBERS |= {w: str(10 * n) for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety hundred".split(), 2)} | {"thousand": "1000", "million": "1000000", "billion": "1000000000"}
_MARKS = (
    ("([\\p{Ll}\\p{N},;:] )(\\p{Lu}\\p{L}+)", f"$1{NAME_MARK}$2"),
    ("([0-9])[.,](?=[0-9])", "$1"),
    (f"(?i)([0-9]) ?({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 {UNIT_MARK}$2"),
)
#: The last of these where a unit may be a name too, and keeps that mark before its own.
_UNIT_MARKS = (f"(?i)([0-9]) ?({NAME_MARK}?)({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1 $2{UNIT_MARK}$3")
_APART = f"[^\\p{{L}}\\p{{N}}{NAME_MARK}{UNIT_MARK}]+"


def tokens(text: Column) -> Column:
    """The token array of a text; names and units start with their mark, a unit that is also a name with both, numbers with a digit."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # the first pattern takes the letter before a name, so names in a row need it twice
    for pattern, to in (_MARKS[0], *_MARKS[:2], _UNIT_MARKS):
        t = F.regexp_replace(t, pattern, to)
    # by way of upper case, so that letters whose upper case is several fold too
    toks = _once(F.filter(F.split(F.lower(F.upper(t)), _APART), lambda x: x != ""))
    return F.get(F.transform(F.array(toks), _with_units), F.lit(0))


def _with_units(toks: Column) -> Column:
    """The tokens with the marks of units after number words."""
    either = lambda words: [m + w for m in ("", NAME_MARK) for w in words]
    marked = lambda w: F.when(_is_name(w), F.concat(F.lit(NAME_MARK + UNIT_MARK), F.substring(w, 2, 1 << 30))).otherwise(F.concat(F.lit(UNIT_MARK), w))
    return F.transform(toks, lambda w, i: F.when(w.isin(either(UNITS.split("|"))) & (i > 0) & F.get(toks, i - 1).isin(either(NUMBERS)), marked(w)).otherwise(w))


def _is_name(token: Column) -> Column:
    return token.startswith(NAME_MARK)


def _plain(token: Column) -> Column:
    """The token without its marks, a number word in digits."""
    bare = F.translate(token, NAME_MARK + UNIT_MARK, "")
    digits = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in pair))
    return F.coalesce(F.try_element_at(digits, bare), bare)


def _is_number(token: Column) -> Column:
    return ((token >= "0") & (token < ":")) | token.isin(list(NUMBERS))


def _is_unit(token: Column) -> Column:
    return token.startswith(UNIT_MARK) | token.startswith(NAME_MARK + UNIT_MARK)


def _kind(token: Column) -> Column:
    """0 literal, 1 number, 2 name, 3 unit."""
    return F.when(_is_number(token), 1).when(_is_name(token), 2).when(token.startswith(UNIT_MARK), 3).otherwise(0)


def _plain_codes(toks: Column) -> Column:
    """A long for each token, whatever its case: its hash, or the number of its placeholder; names are words."""
    number, unit = F.lit(1).cast("long"), F.lit(3).cast("long")
    name = lambda w: F.when(w.isin([NAME_MARK + n for n in NUMBERS]), number).otherwise(F.xxhash64(F.substring(w, 2, 1 << 30)))
    return F.transform(toks, lambda w: F.when(_is_number(w), number).when(_is_unit(w), unit).when(_is_name(w), name(w)).otherwise(F.xxhash64(w)))


def _once(value: Column) -> Column:
    """The value, marked so that the optimiser neither repeats it nor moves a filter on it below its projection.

    A filter on an exploded array would else be moved below the projections,
    where the arrays would be worked out anew for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _with_codes(df: DataFrame) -> DataFrame:
    """Adds __tok, and the codes of its template, __code, and of its plain words, __plain."""
    out = df.withColumn("__tok", _once(tokens(F.col("__text")))).drop("__text").withColumn("__plain", _once(_plain_codes(F.col("__tok"))))
    return out.withColumn("__code", _once(F.transform("__tok", lambda w, i: F.when(_is_name(w), F.lit(2).cast("long")).otherwise(F.get("__plain", i)))))


def _hash(codes: str, start: Column, n: Column | int) -> Column:
    """The hash of n codes from a position counted from 1."""
    return F.xxhash64(F.slice(codes, start, n))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, item_tokens, item_pos, len, hash, item_slots, whole, exact, template, grams): the windows, as template and as plain words, with enough literal tokens.

    Items without such a window come with all they have, or with one window
    if they are shorter than that, and must match as a ``whole``; ``exact``
    ones word for word.  ``item_slots`` has the (offset, kind, value) of the
    placeholders of the item's template, ``grams`` the hashes of the groups in
    the window.
    """
    w = _with_codes(items.select(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").alias("__text"))).where(F.size("__tok") > 0)
    w = w.withColumn("item_tokens", F.size("__tok")).withColumn("len", F.least(F.size("__tok"), F.lit(window)))
    w = w.withColumn("kinds", F.transform("__tok", lambda t: F.struct(_kind(t).alias("kind"), _is_unit(t).alias("unit"))))
    literals = {"__code": lambda ks: F.size(F.filter(ks, lambda k: k["kind"] == 0)), "__plain": lambda ks: F.size(F.filter(ks, lambda k: (k["kind"] != 1) & ~k["unit"]))}
    w = w.withColumn("exact", literals["__code"](F.col("kinds")) < LEAST_LITERAL)
    rows = w.withColumn("item_pos", F.explode(F.sequence(F.lit(0), F.col("item_tokens") - F.col("len"))))
    at = F.col("item_pos") + 1
    inside = F.transform(F.slice("__tok", at, F.col("len")), lambda t, k: F.struct(k.alias("k"), _kind(t).alias("kind"), _plain(t).alias("value")))
    rows = rows.withColumn("item_slots", F.filter(inside, lambda s: s["kind"] > 0))

    def one(codes: str) -> DataFrame:
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.col("len") - GRAM, F.lit(0))), lambda k: _hash(codes, F.col("item_pos") + 1 + k, GRAM))
        enough = (F.col("len") == window) & (literals[codes](F.slice("kinds", at, F.col("len"))) >= LEAST_LITERAL)
        return rows.select("item_id", "item_tokens", "item_pos", "len", _hash(codes, at, F.col("len")).alias("hash"), "item_slots", "exact", F.lit(codes == "__code").alias("template"), grams.alias("grams"), enough.alias("enough"))

    both = one("__code").unionByName(one("__plain"))
    usable = both.groupBy("item_id").agg((~F.max("enough")).alias("whole"))
    both = both.join(usable, "item_id").where("enough or whole")
    return both.groupBy("item_id", "item_tokens", "item_pos", "len", "hash", "item_slots", "whole", "exact").agg(F.max("template").alias("template"), F.flatten(F.collect_set("grams")).alias("grams"))


def _bitmap(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """An array literal of longs with a bit for each hash modulo ``2**bits``, and the bits; sized for n hashes."""
    bits = min(max(n.bit_length() + 6, BITMAP_BITS[0]), BITMAP_BITS[1])
    slot = F.pmod(F.col("hash"), F.lit(1 << bits))
    words = hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {1 << bits}) % 64 as int))")).alias("w")).collect()
    full = [0] * (1 << (bits - 6))
    for i, w in words:
        full[i] = w
    return F.split(F.lit(",".join(map(str, full))), ",").cast("array<bigint>"), bits


def _passes(bitmap: tuple[Column, int], h: Column) -> Column:
    low = h.bitwiseAND(F.lit((1 << bitmap[1]) - 1)).cast("int")
    return F.getbit(F.get(bitmap[0], F.shiftright(low, 6)), low.bitwiseAND(F.lit(63))) == 1


def _hits(src: DataFrame, bench: DataFrame, n: int, window: int) -> DataFrame:
    """(__doc, pos, len, hash, by_template, words): the documents' windows that the benchmark can have."""
    windows = _bitmap(bench.select("hash"), n)
    grams = _bitmap(bench.where(F.col("len") == window).select(F.explode("grams").alias("hash")), n * (window - GRAM + 1))
    short = [r[0] for r in bench.where(F.col("len") < window).select("len").distinct().collect()]
    size = F.size("__tok")
    none = F.array().cast("array<int>")
    starts = F.sequence(F.lit(1), size - GRAM + 1, F.lit(GRAM))
    known = lambda codes: F.filter(starts, lambda s: _passes(grams, _hash(codes, s, GRAM)))
    src = src.withColumn("__near", _once(F.when(size >= window, F.array_union(known("__code"), known("__plain"))).otherwise(none)))
    around = F.flatten(F.transform("__near", lambda p: F.array(*(p - k for k in range(GRAM)))))
    src = src.withColumn("__at", _once(F.filter(around, lambda i: (i >= 1) & (i <= size - window + 1))))

    def found(at: Column, m: int) -> list[Column]:
        one = lambda codes, i: F.struct((i - 1).alias("pos"), F.lit(m).alias("len"), _hash(codes, i, m).alias("hash"), F.lit(codes == "__code").alias("by_template"))
        of = lambda codes: F.filter(F.transform(at, lambda i: one(codes, i)), lambda x: _passes(windows, x["hash"]))
        return [of("__code"), of("__plain")]

    hits = found(F.col("__at"), window)
    for m in short:
        first = F.array(F.lit(1)) if m < LEAST_ALONE else F.sequence(F.lit(1), size - m + 1)
        hits += found(F.when(size == m if m < LEAST_ALONE else size >= m, first).otherwise(none), m)
    src = src.withColumn("__hit", _once(F.array_distinct(F.concat(*hits))))
    words = lambda x: F.transform(F.slice("__tok", x["pos"] + 1, x["len"]), _plain)
    src = src.withColumn("__hit", _once(F.transform("__hit", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len"), x["hash"].alias("hash"), x["by_template"].alias("by_template"), words(x).alias("words")))))
    return src.select("__doc", F.inline("__hit"))


def _one_to_one(pairs: str) -> Column:
    """Whether each item value stands for one document value, and the reverse."""
    single = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p[side])))) == F.size(pairs)
    return single("item") & single("doc")


def _clashing(pairs: str) -> Column:
    """The pairs whose item value stands for several document values."""
    other = lambda p, q: (p["kind"] == q["kind"]) & (p["item"] == q["item"]) & (p["doc"] != q["doc"])
    return F.filter(pairs, lambda p: F.exists(pairs, lambda q: other(p, q)))


def _agrees(hit: Column) -> Column:
    """Whether a window's slots agree with the rest of its diagonal.

    An item value that stands for several document values, itself among them,
    is kept where it stands for itself.  If it isn't among them, only windows
    that are the item's own word for word count.
    """
    same = lambda p: p["item"] == p["doc"]
    of = lambda p: lambda q: (p["kind"] == q["kind"]) & (p["item"] == q["item"])
    lost = F.exists("clashing", lambda p: ~F.exists("clashing", lambda q: of(p)(q) & same(q)))
    return F.forall(hit["pairs"], lambda p: same(p) | ~(lost | F.exists("clashing", of(p))))


def _verdict(hits: str, window: int) -> Column:
    """(matched_tokens, same) of windows on one diagonal: the tokens under them, and whether the slots are the item's own."""
    # a window adds its step from the one before, at most its length
    covered = F.aggregate(F.array_sort(F.array_distinct(F.col(f"{hits}.at"))), F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(window))).alias("n")), lambda a: a["n"])
    return F.struct(F.least(covered, F.col("item_tokens")).alias("matched_tokens"), F.forall(F.flatten(F.col(f"{hits}.pairs")), lambda p: p["item"] == p["doc"]).alias("same"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, item_id, item_tokens, matched_tokens, new_values): the documents that repeat an item or its template.

    ``matched_tokens`` is the most on one consistent diagonal, by templates
    alone, one-to-one, where those suffice, else with the windows of plain
    words, in which case doesn't count, less those that clash; of diagonals
    with as many, one with the item's own values goes before; ``new_values``
    tells whether slots differ from the item's there.  It takes
    ``LEAST_TOKENS`` of them or ``LEAST_SHARE`` of the item, in windows with
    ``LEAST_LITERAL`` literals.  Null and empty texts match nothing; whole
    texts are searched, however long; repeated rows count once; an empty table
    on either side gives no rows; other columns, of whatever name, are left
    out; a null key is a document like others.  The result reads the
    benchmark's windows from ``leak-windows`` in the shared folder.
    """
    bench = stored(benchmark_windows(items, item_key, item_text, window), "leak-windows")
    n = bench.count()
    src = _with_codes(docs.select(F.col(f"`{key}`").alias("__doc"), F.col(f"`{text}`").alias("__text")))
    slim = bench.drop("grams")
    met = _hits(src, bench, n, window).join(F.broadcast(slim) if n <= MOST_BROADCAST else slim, ["hash", "len"])
    pairs = F.transform("item_slots", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("item"), F.get("words", s["k"]).alias("doc")))
    of = ["__doc", "item_id", "item_tokens", "whole", "exact"]
    by = met.groupBy(*of, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set(F.struct(F.col("item_pos").alias("at"), pairs.alias("pairs"), (F.col("template") & F.col("by_template")).alias("strict"))).alias("wide"))
    by = by.withColumn("strict", F.filter("wide", lambda h: h["strict"]))
    for side in ("strict", "wide"):
        by = by.withColumn(f"{side}_pairs", F.array_distinct(F.flatten(F.col(f"{side}.pairs"))))
    by = by.withColumn("clashing", _clashing("wide_pairs")).withColumn("wide", F.filter("wide", _agrees))
    by = by.select(*of, F.when(_one_to_one("strict_pairs"), _verdict("strict", window)).alias("strict"), _verdict("wide", window).alias("wide"))
    best = by.groupBy(*of).agg(F.max("strict").alias("strict"), F.max("wide").alias("wide"))

    def enough(side: str) -> Column:
        matched, total = F.col(f"{side}.matched_tokens"), F.col("item_tokens")
        return F.when(F.col("whole"), (matched == total) & (~F.col("exact") | F.col(f"{side}.same"))).otherwise((matched >= LEAST_TOKENS) | (matched >= total * LEAST_SHARE))

    best = best.withColumn("best", F.when(enough("strict"), F.col("strict")).when(enough("wide"), F.col("wide"))).where("best is not null")
    return best.select(F.col("__doc").alias(key), "item_id", "item_tokens", F.col("best.matched_tokens").alias("matched_tokens"), (~F.col("best.same")).alias("new_values"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_tokens(table: str, key: str) -> str:
    t = "coalesce(text, '')"
    for pattern, to in (_MARKS[0], *_MARKS):
        plain = pattern.replace("(?=[0-9])", "([0-9])").replace("(?![\\p{L}\\p{N}])", "([^\\p{L}\\p{N}]|$)")
        to = to.replace("$1", "\\1").replace("$2", "\\2") + ("\\2" if "(?=" in pattern else "\\3" if "(?!" in pattern else "")
        # what stands for the look-ahead is taken too, so matches in a row need the pattern twice
        for _ in range(2 if "(?" in pattern else 1):
            t = f"regexp_replace({t}, '{plain}', '{to}', 'g')"
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    unit = f"CASE WHEN w IN ({listed(UNITS.split('|'))}) AND tok[i - 1] IN ({listed([*NUMBERS, *(NAME_MARK + n for n in NUMBERS)])}) THEN '{UNIT_MARK}' || w ELSE w END"
    return f"SELECT id, list_transform(tok, lambda w, i: {unit}) AS tok FROM (SELECT {key} AS id, list_filter(string_split_regex(lower({t}), '{_APART}'), lambda x: x <> '') AS tok FROM {table})"


def oracle() -> str:
    numbers = ", ".join(f"'{w}'" for w in NUMBERS)
    digits = lambda w: f"CASE {w} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NUMBERS.items())} ELSE {w} END"
    kind = f"CASE WHEN w >= '0' AND w < ':' OR w IN ({numbers}) THEN 1 WHEN starts_with(w, '{NAME_MARK}') THEN 2 WHEN starts_with(w, '{UNIT_MARK}') THEN 3 ELSE 0 END"
    windows = f"""
        SELECT id, len(tok) AS n, i - 1 AS pos, tok[i : i + {WINDOW - 1}] AS w, kinds[i : i + {WINDOW - 1}] AS k,
            list_transform(range(i, i + {WINDOW}), lambda j: CASE WHEN kinds[j] = 0 THEN tok[j] ELSE CAST(kinds[j] AS VARCHAR) END) AS template
        FROM (SELECT id, tok, list_transform(tok, lambda w: {kind}) AS kinds, unnest(range(1, len(tok) - {WINDOW - 2})) AS i FROM %s)"""
    return f"""
        WITH b AS (SELECT * FROM ({windows % ("(" + _sql_tokens("benchmark", "item_id") + ")")}) WHERE len(list_filter(k, lambda x: x = 0)) >= {LEAST_LITERAL}),
        d AS ({windows % ("(" + _sql_tokens("documents", "doc_id") + ")")}),
        met AS (SELECT d.id AS doc_id, b.id AS item_id, b.n AS item_tokens, d.pos - b.pos AS diagonal, b.pos AS bpos, d.w AS dw, b.w AS bw, b.k AS k FROM d JOIN b ON d.template = b.template),
        slots AS (SELECT DISTINCT doc_id, item_id, diagonal, k[j] AS kind, {digits('bw[j]')} AS item, {digits('dw[j]')} AS doc FROM (SELECT *, unnest(range(1, {WINDOW + 1})) AS j FROM met) WHERE k[j] > 0),
        bad AS (SELECT DISTINCT doc_id, item_id, diagonal FROM (SELECT doc_id, item_id, diagonal, count(*) OVER (PARTITION BY doc_id, item_id, diagonal, kind, item) AS n1, count(*) OVER (PARTITION BY doc_id, item_id, diagonal, kind, doc) AS n2 FROM slots) WHERE n1 > 1 OR n2 > 1),
        new AS (SELECT doc_id, item_id, diagonal, bool_or(item <> doc) AS new_values FROM slots GROUP BY ALL),
        steps AS (SELECT doc_id, item_id, item_tokens, diagonal, least({WINDOW}, bpos - coalesce(lag(bpos) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY bpos), -99)) AS step FROM (SELECT DISTINCT doc_id, item_id, item_tokens, diagonal, bpos FROM met)),
        sums AS (SELECT doc_id, item_id, item_tokens, diagonal, sum(step) AS matched FROM steps GROUP BY ALL),
        kept AS (SELECT s.*, coalesce(n.new_values, false) AS new_values FROM sums s LEFT JOIN new n USING (doc_id, item_id, diagonal) ANTI JOIN bad USING (doc_id, item_id, diagonal)),
        best AS (SELECT doc_id, item_id, item_tokens, max(struct_pack(m := matched, same := NOT new_values)) AS b FROM kept GROUP BY ALL)
        SELECT doc_id, item_id, item_tokens::INTEGER AS item_tokens, b.m::INTEGER AS matched_tokens, NOT b.same AS new_values FROM best WHERE b.m >= {LEAST_TOKENS} OR b.m >= item_tokens * {LEAST_SHARE}"""


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": oracle()}
