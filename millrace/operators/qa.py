"""Question and answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = {"0": "one", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five"}


def highlight_answer(sentence: Column, answer: Column) -> Column:
    """The sentence with the first occurrence of the answer, whatever its case, between marks."""
    at = F.instr(F.lower(sentence), answer)
    return F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit("<hl> "), F.substring(sentence, at, F.length(answer)), F.lit(" <hl>"), F.substring(sentence, at + F.length(answer), F.length(sentence)))


def highlight_each(sentences: Column) -> Column:
    """One extraction input per sentence, that sentence between marks."""
    return F.transform(sentences, lambda _, i: F.concat(F.lit("extract answers: "), F.array_join(F.transform(sentences, lambda s, j: F.when(i == j, F.concat(F.lit("<hl> "), s, F.lit(" <hl>"))).otherwise(s)), " ")))


def prepend_input(answer: Column, context: Column) -> Column:
    return F.concat(F.lit("answer: "), answer, F.lit(" context: "), context)


def qa_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("question: "), question, F.lit("  context: "), context)


def e2e_prompt(context: Column) -> Column:
    return F.concat(F.lit("generate questions: "), context)


def split_answers(decoded: Column) -> Column:
    """Answers before each separator; what follows the last one isn't an answer."""
    parts = F.split(F.replace(decoded, F.lit("<pad>"), F.lit("")), "<sep>")
    return F.filter(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")


def element_scores(elements: DataFrame, image: str) -> DataFrame:
    """(image, scores): a map of each element to its best score, at least 0."""
    best = elements.groupBy(image, "element").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best.groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "score")))).alias("scores"))


def spatial_questions(boxes: DataFrame, image: str, cutoff: float) -> DataFrame:
    """(image, question, answer) from box places on a 100 by 100 grid, taken in box order.

    A box over 85 wide or high is the background; a smaller one is at the
    centre, left, right, top or bottom, and stands in relation to the small
    one before it.  One fold over an image's boxes.
    """
    packed = boxes.where(F.col("score") >= cutoff).groupBy(image).agg(F.array_sort(F.collect_list(F.struct("box", "x1", "y1", "x2", "y2", "element"))).alias("all"))
    qa = "array<struct<question:string,answer:string>>"
    start = F.struct(F.lit(None).cast("struct<element:string,x:double,y:double>").alias("last"), F.array().cast(qa).alias("out"))
    ask = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))

    def step(acc: Column, b: Column) -> Column:
        x, y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
        wide = ((b["x2"] - b["x1"]) > 85) | ((b["y2"] - b["y1"]) > 85)
        place = F.when(x.between(40, 60) & y.between(40, 60), "in the center").when(x < 25, "on the left").when(x > 75, "on the right").when(y < 25, "on the top").when(y > 75, "on the bottom")
        near = F.when(x < acc["last"]["x"] - 15, "left of").when(x > acc["last"]["x"] + 15, "right of").when(y < acc["last"]["y"] - 15, "above").when(y > acc["last"]["y"] + 15, "below")
        made = F.array_compact(
            F.array(
                F.when(wide, ask(F.lit("What is in the background?"), b["element"])),
                F.when(~wide & place.isNotNull(), ask(F.concat(F.lit("What is "), place, F.lit("?")), b["element"])),
                F.when(~wide & near.isNotNull() & (acc["last"]["element"] != b["element"]), ask(F.concat(F.lit("What is "), near, F.lit(" the "), acc["last"]["element"], F.lit("?")), b["element"])),
            )
        )
        last = F.when(wide, acc["last"]).otherwise(F.struct(b["element"].alias("element"), x.alias("x"), y.alias("y")))
        return F.struct(last.alias("last"), F.concat(acc["out"], made).alias("out"))

    return packed.select(image, F.explode(F.array_distinct(F.aggregate("all", start, step, lambda a: a["out"]))).alias("qa")).select(image, "qa.question", "qa.answer")
