"""Prompt sets: the configuration file reader and the built-in prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.operators.generate import Step
from pairloom.operators.postprocess import FEW_SHOT_ANSWERS


# The few-shot examples and the texts of the built-in prompts.
DOCUMENTS = [
    "We don't know a lot about the effects of caffeine during pregnancy on you and your baby. So it's best to limit the amount you get each day. If you are pregnant, limit caffeine to 200 milligrams each day. This is about the amount in 1½ 8-ounce cups of coffee or one 12-ounce cup of coffee.",
    "Passiflora herbertiana. A rare passion fruit native to Australia. Fruits are green-skinned, white fleshed, with an unknown edible rating. Some sources list the fruit as edible, sweet and tasty, while others list the fruits as being bitter and inedible.",
    "The Canadian Armed Forces. 1 The first large-scale Canadian peacekeeping mission started in Egypt on November 24, 1956. 2 There are approximately 65,000 Regular Force and 25,000 reservist members in the Canadian military. 3 In Canada, August 9 is designated as National Peacekeepers' Day.",
]
KEYWORDS = [
    "Caffeine, Pregnancy, Coffee, Effects, Baby, Limit, Miligrams, Amount",
    "Passiflora herbertiana, Passion fruit, Australia, Green-skinned, White fleshed, Edible, Sweet, Tasty, Bitter, Inedible",
    "Canadian Armed Forces, Peacekeeping, Egypt, Regular Force, Reservist, Military, National Peackeeper's Day, Large-scale mission, Members",
]
TITLES = [
    "Caffeine and Pregnancy: What We Know and What We Don't",
    "Passiflora Herbertiana: A Rare Passion Fruit from Australia",
    "Canadian Peacekeeping: A Legacy of Service",
]
INSTRUCTION = "Generate a question that can answer this document: {}\n"


def few_shot(*parts: tuple[str, list[str]], holes: tuple[str, ...] = ("Document",)) -> str:
    """Numbered examples with one line per part, then the unanswered example with its holes."""
    blocks = []
    for i, values in enumerate(zip(*(texts for _, texts in parts)), 1):
        lines = [f"{label}: {text}" for (label, _), text in zip(parts, values)]
        blocks.append("\n".join([f"Example {i}:", *lines]))
    last = "\n".join([f"Example {len(blocks) + 1}:", *(f"{h}: {{}}" for h in holes)])
    return "\n\n".join([*blocks, last + "\n"])


def builtin_prompts() -> dict[str, list[Step]]:
    docs, queries = ("Document", DOCUMENTS), ("Relevant Query", FEW_SHOT_ANSWERS)
    words, titles = ("Keywords", KEYWORDS), ("Title", TITLES)
    return {
        "standard": [Step(few_shot(docs, queries), "Relevant Query:")],
        "keywords": [
            Step(few_shot(docs, words), "Keywords:"),
            Step(few_shot(docs, words, queries, holes=("Document", "Keywords")), "Relevant Query:"),
        ],
        "title": [
            Step(few_shot(docs, titles), "Title:"),
            Step(few_shot(docs, titles, queries), "Relevant Query:"),
        ],
        "instruct-gpt": [Step(INSTRUCTION, "")],
    }


class UnknownPrompt(KeyError):
    pass


def parse_prompts(files: DataFrame) -> DataFrame:
    """prompts(name, is_external, info, steps) from whole prompt files in column ``value``.

    A file maps names to an object with ``steps`` (a number), ``info``, ``is_external`` and one
    object per step under its number. It is a small configuration file.
    """
    named = files.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("name", "body"))
    step = "STRUCT<prompt: STRING, next_step: STRING>"
    body = named.withColumn("b", F.from_json("body", "MAP<STRING, STRING>"))
    number = F.coalesce(F.col("b")["steps"].cast("int"), F.lit(0))
    places = F.when(number > 0, F.sequence(F.lit(0), number - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.transform(places, lambda i: F.from_json(F.col("b")[i.cast("string")], step))
    return body.select("name", F.col("b")["is_external"].cast("boolean").alias("is_external"),
                       F.col("b")["info"].alias("info"), listed.alias("steps"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return parse_prompts(spark.read.text(path, wholetext=True))


def prompt_named(prompts: DataFrame, name: str) -> list[Step]:
    """The steps of one prompt; fails on an unknown name."""
    found = prompts.filter(F.col("name") == name).select("steps").first()
    if found is None:
        raise UnknownPrompt(name)
    return [Step(s["prompt"], s["next_step"]) for s in found["steps"]]
