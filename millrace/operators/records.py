"""Caption pairs, answer gates and question lists as column expressions.

Word lists, templates' subjects and default answers are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strs, uniform

#: Characters cut off both ends of a caption, answers that say nothing, picture types that are always asked for.
EDGE = " .-,:;"
NO_ANSWER = ("true", "false", "yes", "no")
DRAWN = ("rendering", "art", "cartoon", "illustration", "drawing", "sketch")

#: Questions and the wording of people counts.
FEELING, AGE, RELIGION, RACE, GENDER = "What is {} feeling?", "How old is {}?", "What religion is {}?", "What race is {}?", "What gender is the person?"
COLOR, SHAPE = "What color is {}?", "What shape is {}?"
PEOPLE = {"0": "one person", "1": "one person", "2": "two people", "3": "three people", "4": "four people", "5": "five people"}

QA = "array<struct<subject:string,qa:string>>"


def strip_edges(t: Column) -> Column:
    return F.btrim(t, F.lit(EDGE))


def repair_pair(df: DataFrame, txt: str = "txt", slug: str = "slug") -> DataFrame:
    """``df`` with the blank-set possessive of the slug joined, ``actor`` following an actress's slug, and both sides' edges cut."""
    slug_s = F.replace(F.col(slug), F.lit(" s "), F.lit(" 's "))
    actress = F.startswith(slug_s, F.lit("actress")) & F.startswith(F.col(txt), F.lit("actor"))
    fixed = F.when(actress, F.replace(F.col(txt), F.lit("actor"), F.lit("actress"))).otherwise(F.col(txt))
    return df.withColumns({txt: strip_edges(fixed), slug: strip_edges(slug_s)})


def drop_suffixes(df: DataFrame, txt: str = "txt", slug: str = "slug") -> DataFrame:
    """``df`` without `` image`` and `` by person`` in captions that end with them.

    A slug that ends with `` image`` replaces the caption (without the word);
    one that ends with `` by person`` is itself rewritten.
    """
    without = lambda c, tail: F.replace(c, F.lit(tail), F.lit(""))
    ends = lambda c, tail: F.endswith(c, F.lit(tail))
    t, s = F.col(txt), F.col(slug)
    own = F.when(ends(t, " image"), without(t, " image")).otherwise(t)
    t = F.when(ends(s, " image"), without(s, " image")).otherwise(own)
    t = let(t, lambda x: F.when(ends(x, " by person"), without(x, " by person")).otherwise(x))
    return df.withColumns({txt: t, slug: F.when(ends(s, " by person"), without(s, " by person")).otherwise(s)})


def entity_candidate(phrase: Column, stop: Sequence[str]) -> Column:
    """Whether a phrase of a tagger can stand as an element: over 4 characters and no stop word."""
    return (F.length(phrase) > 4) & ~F.lower(phrase).isin(*stop)


def object_candidate(phrase: Column, stop: Sequence[str]) -> Column:
    """Whether a noun phrase counts as an object: 5 to 7 characters and no stop word."""
    return entity_candidate(phrase, stop) & (F.length(phrase) < 8)


def answer_gate(answer: Column, key: Column, common: Sequence[str], step: str = "gate", seed: int = 0) -> Column:
    """Whether a model's answer says something: common words pass in one draw of three only."""
    drawn = F.floor(uniform(key, step, seed) * 3) == 0
    return ~answer.isin(*NO_ANSWER) & (drawn | ~answer.isin(*common))


def people_answer(answer: Column) -> Column:
    """Counts of people in words; other answers stay."""
    table = F.create_map(*(F.lit(x) for kv in PEOPLE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, answer), answer)


def _ask(question: str, subject: Column, answer: Column) -> Column:
    head, _, tail = question.partition("{}")
    return F.struct(subject.alias("subject"), F.concat(F.lit(head), *([subject, F.lit(tail)] if "{}" in question else []), F.lit("||"), answer).alias("qa"))


def _among(ws: Column, words: Sequence[str]) -> Column:
    allowed = strs(*words)
    return F.filter(ws, lambda w: F.array_contains(allowed, w))


def _first(question: str, subject: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, _ask(question, subject, F.get(found, F.lit(0))))


def person_questions(ws: Column, persons: Sequence[str], emotions: Sequence[str], ages: Sequence[str], religions: Sequence[str], races: Sequence[str]) -> Column:
    """Questions that the words of an augmented person answer, as (subject, question||answer).

    Feeling and age name the last two words (``person`` when neither they nor
    the last word are a known person), the others the last of these. The
    gender answer is the list of known persons as text, asked unless the
    subject is a ``person``. A phrase with a known person that doesn't end
    with one gets no gender question.
    """
    known = strs(*persons)
    last = F.element_at(ws, -1)
    pair = F.array_join(F.slice(ws, F.greatest(F.size(ws) - 1, F.lit(1)), F.lit(2)), " ")
    whole = F.when(F.array_contains(known, pair) | F.array_contains(known, last), pair).otherwise(F.lit("person"))
    genders = _among(ws, [p for p in persons if p != "person"])
    listed = F.concat(F.lit("["), F.array_join(F.transform(genders, lambda g: F.concat(F.lit("'"), g, F.lit("'"))), ", "), F.lit("]"))

    def ask(who: Column) -> Column:
        one = F.substring_index(who, " ", -1)
        gender = F.when((F.array_contains(known, last) | (F.size(genders) == 0)) & ~F.contains(one, F.lit("person")), _ask(GENDER, one, listed))
        return F.array_compact(F.array(_first(FEELING, who, _among(ws, emotions)), _first(AGE, who, _among(ws, ages)), _first(RELIGION, one, _among(ws, religions)), _first(RACE, one, _among(ws, races)), gender))

    return F.when(F.size(ws) > 0, let(whole, ask)).otherwise(F.array().cast(QA))


def thing_questions(ws: Column, colors: Sequence[str], shapes: Sequence[str], place: bool = False) -> Column:
    """Colour questions of an augmented thing (all words but the first), of a place (its last two words) shapes too."""
    subject = F.array_join(F.slice(ws, F.greatest(F.size(ws) - 1, F.lit(1)), F.lit(2)) if place else F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), " ")
    asked = [_first(COLOR, subject, _among(ws, colors))]
    if place:
        asked.append(_first(SHAPE, subject, _among(ws, shapes)))
    return F.array_compact(F.array(*asked))


def picture_questions(kind: Column, image_type: Column, moods: Sequence[str], key: Column, seed: int = 0) -> Column:
    """(subject, question||answer) on genre or mood, and on the type of picture.

    The type is asked in one draw of two, of drawn pictures always; none, or
    ``picture``, is a photo.
    """
    ask = lambda s, q, a: F.struct(F.lit(s).alias("subject"), F.concat(F.lit(q + "||"), a).alias("qa"))
    what = F.when(kind != "", F.when(kind.isin(*moods), ask("mood type", "What is the mood of this picture?", kind)).otherwise(ask("genre type", "What is the genre of this picture?", kind)))
    always = F.exists(strs(*DRAWN), lambda d: F.contains(image_type, d))
    shown = F.when(image_type.isin("", "picture"), F.lit("photo")).otherwise(image_type)
    picture = F.when(always | (uniform(key, "picture", seed) <= 0.5), ask("picture type", "What type of picture is this?", shown))
    return F.array_compact(F.array(what, picture))


def regeneration_words(elements: Column, sentence: Column, cutoff: float) -> Column:
    """Elements (of structs ``element``, ``score``) of a high score that stand in the sentence, comma-separated."""
    return F.array_join(F.transform(F.filter(elements, lambda e: (e["score"] >= cutoff) & F.contains(sentence, e["element"])), lambda e: e["element"]), ", ")


def with_default_answers(answers: Column, general: Sequence[str] = (), own: Column | None = None) -> Column:
    """All answers of a text in one list: those per sentence, then the general ones, then the text's own."""
    more = [F.array(strs(*general))] if general else []
    if own is not None:
        more.append(F.array(F.coalesce(own, F.array().cast("array<string>"))))
    return F.flatten(F.concat(answers, *more))


def map_union(left: Column, right: Column) -> Column:
    """Both maps' entries; of a key in both the right one's."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def keyword_universe(json_names: Column, source: DataFrame, *lists: DataFrame) -> DataFrame:
    """(word): the distinct ``name`` of a JSON object's values, and the words of further one-column tables."""
    objects = F.map_values(F.from_json(json_names, "map<string,struct<name:string>>"))
    words = source.select(F.explode(F.transform(objects, lambda o: o["name"])).alias("word"))
    for more in lists:
        words = words.unionByName(more.toDF("word"))
    return words.where("word IS NOT NULL").distinct()


def special_tokens(given: Column, extra: Column, visual: Column) -> Column:
    """The special tokens with the visual ones behind; an error unless as many extra ids as said are given."""
    ids = F.array_distinct(F.filter(given, lambda t: F.contains(t, F.lit("<extra_id"))))
    wrong = (extra > 0) & (F.size(ids) != extra)
    more = F.when(visual > 0, F.transform(F.sequence(F.lit(0), F.greatest(visual, F.lit(1)) - 1), lambda i: F.concat(F.lit("<vis_extra_id_"), i.cast("string"), F.lit(">")))).otherwise(F.array().cast("array<string>"))
    return F.when(wrong, F.raise_error(F.lit("the special tokens must include the extra ids"))).otherwise(F.concat(given, more))
