"""Column functions for cleaning prompts, captions and URL slugs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and words of the cleaning rules.
EDGE = " .-,:;"
PROMPT_EDGE = "+-.;: "
PROMPT_TAIL = "0123456789+-.;:"
DETERMINERS = ("d", "a", "an", "the")
AFTER_DETERMINER = ("a", "an", "above", "the", "of", "in", "during")
STOCK_TAIL = ("stock", "id")
BETWEEN_PERSONS = ("of", "person", "during", "at", "in", "a", "an", "the", "with", "and", "or", ",")
JOINING = ("with", "and", "or", ",")
LEADING = ("d", "of", "with", "to", "in", "during", "about")
SLUG_TAIL = ("copy", "the", "a", "an", "on", "of", "at", "during", "between", "near", "by", "in", "with", "his", "hers")
SLUG_HEAD = ("of", "by", "0", ":", "-", ",")
VOWELLESS = ("gym", "sky", "why", "mtv", "nyc", "nv", "ny", "lynch")
PLACEHOLDER = "You are visiting the placeholder page"
BLOCKED = (("free", "dating", "sex", "fuck", "cock", "pussy", "xxx"), ("free", "viagra", "cialis"))
BOILERPLATE = (
    ("because this is pdf file * PDF *", " ... "), ("no short description", " ... "), ("Field of the Invention", ""), ("The present invention relates to", ""), ("Description of the Prior Art", ""), ("Prior Art", ""),
)
GENRES = (
    ("patent", (" patent ", " invention ", " prior art ")), ("legal", (" court ", " lawyer ", " plaintiff ", " defendant ", " attorney ")), ("scientific", (" genetic ", " gene ", " anatomy ", " cell ")), ("medical", (" clinical ", " diagnosis ", " surgery ")),
)
# Each step: its name, its chance, what it asks for, and its ordered replacements.  All of the first list are tried, of the second the first that is drawn.
SWAPS = (
    ("men", 1 / 3, ("men ", " Men ", "men's ", " Men's "), (("men ", " women "), (" Men ", " Women "), ("men's ", "women's "), (" Men's ", " Women's "))),
    ("man", 1 / 3, ("man ", " Man ", "man's ", " Man's "), (("man ", "woman "), (" Man ", " Woman "), ("man's ", "woman's "), (" Man's ", " Woman's "))),
    ("boys", 1 / 3, (" boys ", " Boys ", " boys' ", " Boy's "), ((" boys ", " girls "), (" Boys ", " Girls "), (" boys' ", " girls' "), (" Boys' ", " Girls' "))),
    ("boy", 1 / 3, (" boy ", " Boy ", " boy's ", " Boy's "), ((" boy ", " girl "), (" Boy ", " Girl "), (" boy's ", " girl's "), (" Boy's ", " Girl's "))),
)
SWAPS_ONE_OF = (
    ("me", 1 / 3, (" me ", " Me "), ((" me ", " her "), (" myself ", " herself "), (" I ", " she "), (" my ", " her "), (" mine ", " hers "), (" Me ", " Her "), (" My ", " Her "), (" Mine ", " Hers "), (" Myself ", " Herself "))),
    ("you", 1 / 3, (" you", " You"), ((" you ", " she "), (" your ", " her "), (" yourself ", " herself "), (" yours ", " hers "), (" You ", " She "), (" Your ", " Her "), (" Yours ", " Hers "), (" Yourself ", " Herself "))),
    ("he", 1 / 3, (" he ", " He "), ((" he ", " she "), (" him ", " her "), (" himself ", " herself "), (" his ", " her "), (" He ", " She "), (" Him ", " Her "), (" His ", " Her "), (" Himself ", " Herself "))),
    ("she", 1 / 5, (" she ", " She "), ((" she ", " he "), (" her ", " him "), (" hers ", " his "), (" She ", " He "), (" Her ", " Him "), (" Hers ", " His "))),
)
SWAP_REPAIRS = (("Huwoman", "Human"), ("huwoman", "human"), ("Gerwoman", "German"), ("gerwoman", "german"), ("wo wom", "wom"))


def once(value: Column) -> Column:
    """The value, kept by the optimiser in its projection: a filter on it isn't moved below and doesn't repeat it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strs(*words: str) -> Column:
    return F.array(*map(F.lit, words))


def cut_flags(t: Column) -> Column:
    """The text before the first ``--``."""
    return F.substring_index(t, "--", 1)


def prompt_pass(t: Column) -> Column:
    """One pass of prompt normalisation."""
    t = F.replace(F.replace(F.replace(t, F.lit("::"), F.lit(" ")), F.lit("  "), F.lit(" ")), F.lit(" ,"), F.lit(", "))
    t = F.btrim(F.substring_index(t, "—", 1), F.lit(PROMPT_EDGE))
    t = F.lower(F.rtrim(t, F.lit(PROMPT_TAIL)))
    return F.btrim(F.replace(F.replace(t, F.lit("/imagine prompt:"), F.lit("")), F.lit("/imagine"), F.lit("")), F.lit("/ "))


def usable_prompt(t: Column) -> Column:
    return (F.length(t) > 20) & (F.left(t, F.lit(1)) != "<")


def normalise_prompt(t: Column, passes: int = 6) -> Column:
    """The prompt after ``passes`` passes; null if the value that enters one of them isn't usable."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), t, lambda acc, _: F.when(usable_prompt(acc), prompt_pass(acc)))


def prompt_key(t: Column) -> Column:
    """Deduplication key: the first 20 characters without blanks, full stops, commas and quotes."""
    return F.translate(F.left(t, F.lit(20)), " .,'\"", "")


def words(t: Column) -> Column:
    """Words between Unicode white space; none for an empty text."""
    return F.filter(F.split(t, "(?U)\\s+"), lambda x: x != "")


def _bounded(phrases: Sequence[str]) -> Column:
    """Each phrase with the blank after it, then with the one before it: a constant list, made once and not for each row."""
    return strs(*(x for p in phrases for x in (f"{p} ", f" {p}")))


def has_phrase(t: Column, phrases: Sequence[str]) -> Column:
    """Whether a phrase stands before or after a blank."""
    return let(t, lambda t: F.exists(_bounded(phrases), lambda p: F.contains(t, p)))


def delete_phrases(t: Column, phrases: Sequence[str]) -> Column:
    """Deletes phrases in the given order, each with the blank after it, then with the one before it."""
    fold = lambda t: F.aggregate(_bounded(phrases), t, lambda acc, p: F.replace(acc, p, F.lit("")))
    return let(t, lambda t: F.when(has_phrase(t, phrases), fold(t)).otherwise(t))


def replace_pairs(t: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def longest_first(phrases: Sequence[str]) -> list[str]:
    return sorted(phrases, key=len, reverse=True)


def drop_determiner(w: Column) -> Column:
    hit = lambda w: (F.size(w) > 2) & F.get(w, F.lit(0)).isin(*DETERMINERS) & F.get(w, F.lit(1)).isin(*AFTER_DETERMINER)
    return let(w, lambda w: F.when(hit(w), F.slice(w, 2, F.size(w))).otherwise(w))


def _cut_tail(w: Column, tail: Sequence[str], low: bool = False) -> Column:
    """Drops two words for as long as the last one is of ``tail``."""

    def step(acc: Column, _: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        hit = (F.lower(last) if low else last).isin(*tail)
        return F.when(hit, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 2, F.lit(0)))).otherwise(acc)

    return let(w, lambda w: F.when(F.size(w) > 0, F.aggregate(F.sequence(F.lit(1), F.size(w)), w, step)).otherwise(w))


def drop_stock_tail(w: Column) -> Column:
    return _cut_tail(w, STOCK_TAIL)


def collapse_persons(w: Column) -> Column:
    """``person X person ...``: three words go, and after a joining X the next one becomes ``people``."""

    def body(w: Column) -> Column:
        hit = (F.size(w) > 3) & (F.get(w, F.lit(0)) == "person") & F.get(w, F.lit(1)).isin(*BETWEEN_PERSONS) & (F.get(w, F.lit(2)) == "person")
        return F.when(hit & F.get(w, F.lit(1)).isin(*JOINING), F.concat(strs("people"), F.slice(w, 5, F.size(w)))).when(hit, F.slice(w, 4, F.size(w))).otherwise(w)

    return let(w, body)


def drop_while(w: Column, stop: Column) -> Column:
    """The words from the first one on that isn't in the array ``stop``."""
    return let(w, lambda w: _from_first(w, lambda x: ~F.array_contains(stop, x)))


def _from_first(w: Column, wanted: Callable[[Column], Column]) -> Column:
    at = lambda w: F.array_position(F.transform(w, lambda x: F.when(wanted(x), 0).otherwise(1)), F.lit(0)).cast("int")
    return F.when(at(w) > 0, F.slice(w, F.greatest(at(w), F.lit(1)), F.size(w))).otherwise(F.slice(w, 1, 0))


def clean_words(t: Column) -> Column:
    """The caption's words after all edge rules; empty if nothing is left."""
    w = drop_determiner(words(F.btrim(t, F.lit(EDGE))))
    return drop_while(collapse_persons(drop_stock_tail(w)), strs(*LEADING))


def unquote(u: Column) -> Column:
    """Decodes ``%xx``, keeps ``+``; what cannot be decoded stays as it is."""
    raw = F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B")))
    t = F.coalesce(raw, u)
    return F.replace(F.replace(F.replace(t, F.lit("\n"), F.lit(". ")), F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(". "))


def slug(u: Column) -> Column:
    t = F.element_at(F.split(u, "/"), -1)
    t = F.substring_index(F.substring_index(t, ".", 1), "?", 1)
    return F.translate(t, "-+_", "   ")


def slug_words(u: Column) -> Column:
    """Words of a URL's last part, without serial numbers and capitals, vowelless ends and function words at the ends."""
    keep = lambda t: (F.lower(t) == "3d") | (F.length(t) < 5) | (~t.rlike("[0-9]") & (F.length(t) < 20) & (F.upper(t) != t))

    def cut(w: Column) -> Column:
        last = F.lower(F.get(w, F.size(w) - 1))
        return F.when((F.size(w) > 0) & ~last.rlike("[aeiou]") & ~last.isin(*VOWELLESS), F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))).otherwise(w)

    w = _cut_tail(let(F.filter(words(slug(u)), keep), cut), SLUG_TAIL, low=True)
    return let(w, lambda w: _from_first(w, lambda x: ~F.lower(x).isin(*SLUG_HEAD)))


def slug_or_caption(slug_w: Column, caption_w: Column, ignore: Sequence[str]) -> Column:
    """The slug as text, or the caption if the slug is short, mostly junk or of an ignored kind."""
    junk_free = F.regexp_replace(F.array_join(F.filter(slug_w, lambda x: F.length(x) >= 3), ""), "[0-9]", "")
    share = F.length(junk_free) / F.nullif(F.length(F.array_join(slug_w, "")), F.lit(0))
    w = F.when((F.size(slug_w) <= 2) | (F.coalesce(share, F.lit(0)) < 0.65) | (F.length(junk_free) == 0), caption_w).otherwise(slug_w)
    marked = lambda t: F.exists(strs(*(f"{p} " for p in ignore)), lambda p: F.contains(t, p))
    return let(F.array_join(w, " "), lambda t: F.when(marked(t), F.array_join(caption_w, " ")).otherwise(t))


def collapse_key(t: Column) -> Column:
    """The first three letters of each word of three or more, without ``, . - :``, in lower case."""
    w = F.filter(words(F.lower(F.translate(t, ",.-:", ""))), lambda x: F.length(x) >= 3)
    return F.array_join(F.transform(w, lambda x: F.left(x, F.lit(3))), "")


def keep_longer(a: Column, b: Column) -> Column:
    """Of two texts whose collapse keys are equal or contain each other the longer one, else null."""
    x, y = collapse_key(a), collapse_key(b)
    return F.when((x == y) | F.contains(x, y) | F.contains(y, x), F.when(F.length(a) >= F.length(b), a).otherwise(b))


def normalise_url(u: Column) -> Column:
    return F.concat(F.lit("http:"), F.element_at(F.split(F.replace(F.lower(u), F.lit("https:"), F.lit("http:")), "http:"), -1))


def valid_url(u: Column) -> Column:
    """The URL if it starts with http and has no comma, else the empty text."""
    return F.when(u.startswith("http") & ~F.contains(u, F.lit(",")), u).otherwise(F.lit(""))


def count_substrings(t: Column, terms: Sequence[str]) -> Column:
    """How often the terms occur in all, each counted without overlaps."""
    out = F.lit(0)
    for w in terms:
        out = out + ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return out


def genre(t: Column) -> Column:
    """The first genre one of whose words, between blanks, occurs in the text in any case, else the empty text."""
    out, t = None, F.lower(t)
    for name, terms in GENRES:
        hit = F.lit(False)
        for w in terms:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def sentences(t: Column) -> Column:
    """Candidate sentences: parts at ``? ! "- " ;`` and full stops of over 20 characters, and the whole text if there are several."""
    s = t
    for mark in ("? ", "! ", "- ", "; "):
        s = F.replace(s, F.lit(mark), F.lit(". "))
    parts = F.split(s, "\\. ")
    all_ = F.when(F.size(parts) > 1, F.concat(parts, F.array(t))).otherwise(parts)
    return F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: F.length(x) > 20)


def prefix4(w: Column) -> Column:
    return F.transform(w, lambda x: F.left(F.lower(x), F.lit(4)))


def shares_prefix(a: Column, b: Column) -> Column:
    """Whether a word of ``a`` has the same first four letters as one of ``b``; false if either is empty."""
    return F.coalesce(F.arrays_overlap(prefix4(a), prefix4(b)), F.lit(False)) & (F.size(a) > 0) & (F.size(b) > 0)


def uniform(key: Column, step: str, seed: int = 0) -> Column:
    """A reproducible draw from [0, 1): 32 bits of the MD5 of key, seed and step."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(step))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)


def replace_first(t: Column, a: Column, b: Column) -> Column:
    at = F.instr(t, a)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), b, F.substring(t, at + F.length(a), F.length(t)))).otherwise(t)


def any_of(t: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(t, F.lit(w))
    return out


def strip_boilerplate(t: Column) -> Column:
    """Fixed phrases replaced in order; a text that starts with ``stock`` loses the word everywhere, and its edges' white space."""
    t = replace_pairs(t, BOILERPLATE)
    return F.when(t.startswith("stock "), F.regexp_replace(F.replace(t, F.lit("stock"), F.lit("")), "^\\s+|\\s+$", "")).otherwise(t)


def split_inline_qa(t: Column) -> tuple[Column, Column]:
    """The text without its inline question, and ``question?||answer``, empty if there is none; the question starts after the last full stop."""
    at = F.instr(t, F.lit("?||"))
    parts = F.split(F.left(t, at - 1), "\\.")
    qa = F.trim(F.concat(F.element_at(parts, -1), F.substring(t, at, F.length(t))))
    rest = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")
    return F.when(at > 0, rest).otherwise(t), F.when(at > 0, qa).otherwise("")


def swap_genders(t: Column, key: Column) -> Column:
    """The steps of the swap lists that apply and are drawn for the key, then the repairs."""
    for name, chance, asked, pairs in SWAPS:
        t = let(t, lambda x: F.when(any_of(x, asked) & (uniform(key, name) < chance), replace_pairs(x, pairs)).otherwise(x))  # noqa: B023

    def one_of(x: Column) -> Column:
        out = None
        for name, chance, asked, pairs in SWAPS_ONE_OF:
            drawn, to = any_of(x, asked) & (uniform(key, name) < chance), replace_pairs(x, pairs)
            out = F.when(drawn, to) if out is None else out.when(drawn, to)
        return out.otherwise(x)

    return replace_pairs(let(t, one_of), SWAP_REPAIRS)
