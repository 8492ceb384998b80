import pytest
from pyspark.sql import functions as F

from pairloom.functions import crop, text as txt
from pairloom.operators import report
from pairloom.sources.prompts import UnknownPrompt, builtin_prompts, parse_prompts, prompt_named


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("answer, expected", [
    ("abc", "ab"), ("\nabc", ""), (" what is it?\nmore", "what is it?"), ("", ""), ("a", "")])
def test_answer(spark, answer, expected):
    got = one(spark, txt.answer_extract(F.col("c"), F.col("p")), c="prompt {}" + answer, p="prompt {}")
    assert got == expected


def test_answer_can_keep_the_last_character(spark):
    assert one(spark, txt.answer_extract(F.col("c"), F.col("p"), False), c="Pabc", p="P") == "abc"


def test_prompt_keeps_braces_and_dollars(spark):
    built = txt.prompt_build("D: {}\nT: {}\n", [F.col("a"), F.col("b"), F.col("b")], "Q:")
    assert one(spark, built, a="x {} $1 \\", b="t") == "D: x {} $1 \\\nT: t\nQ:"
    with pytest.raises(ValueError):
        txt.prompt_build("{} {}", [F.col("a")])


def test_surplus_value_is_ignored(spark):
    assert one(spark, txt.prompt_build("{}!", [F.col("a"), F.col("b")]), a="x", b="y") == "x!"


def test_white_space_is_that_of_python():
    assert [ord(c) for c in txt.WHITE_SPACE] == [i for i in range(0x110000) if chr(i).isspace()]


@pytest.mark.parametrize("text", ["", " \u3000", "\xa0 a\u2003b \x1f", "x", "\u200bx\u200b"])
def test_strip_equals_python(spark, text):
    assert one(spark, txt.strip(F.col("a")), a=text) == text.strip()


def test_strip_and_ascii(spark):
    assert one(spark, txt.strip(F.col("a")), a="  \t a b \n") == "a b"
    assert one(spark, txt.ascii_strip(F.col("a")), a="naïve ½ cup") == "nave  cup"
    assert one(spark, txt.doc_truncate(F.col("a"), 2), a="é½x") == "é½"


def test_passages(spark):
    assert one(spark, txt.passage_text(F.col("t"), F.col("x"), " [SEP] "), t=None, x="b ") == " [SEP] b "
    assert one(spark, txt.passage_for_encoder(F.col("t"), F.col("x")), t=None, x=" b ") == "b"
    assert one(spark, txt.passage_for_encoder(F.col("t"), F.col("x")), t="", x="b") == "b"


@pytest.mark.parametrize("query, word", [(" what is", "What"), ("", ""), ("ÉTAT x", "État")])
def test_first_word(spark, query, word):
    assert one(spark, txt.first_word(F.col("q")), q=query) == word


@pytest.mark.parametrize("text", ["", "one", "a  b", "x " * 500])
def test_crop_is_a_part_of_the_text(spark, text):
    got = one(spark, crop.crop_text(F.col("t"), 3, "q", F.lit(1)), t=text)
    assert len(got.split(" ")) <= max(1, len(text.split(" ")) // 2)


def test_crop_lengths_and_deletions(spark):
    """Spans take 10% to 50% of the words; a tenth of their words is deleted."""
    df = spark.range(400).select(F.col("id").alias("pos"), F.lit(" ".join(["w"] * 200)).alias("text"))
    pairs = crop.crop_pair(df, 5).select(F.size(F.split("query", " ")).alias("q"), F.size(F.split("document", " ")).alias("d"))
    stats = pairs.agg(F.min("q"), F.max("q"), F.avg("q"), F.avg("d"), F.corr("q", "d")).first()
    assert 10 <= stats[0] and stats[1] <= 100
    assert abs(stats[2] - 54) < 4 and abs(stats[3] - 54) < 4 and abs(stats[4]) < 0.2


def test_builtin_prompts():
    prompts = builtin_prompts()
    assert {n: len(s) for n, s in prompts.items()} == {"standard": 1, "keywords": 2, "title": 2, "instruct-gpt": 1}
    assert prompts["standard"][0].prompt.endswith("\n\nExample 4:\nDocument: {}\n")
    assert prompts["keywords"][1].prompt.count("{}") == 2 and prompts["title"][1].prompt.count("{}") == 1


def test_prompt_file(spark):
    body = ('{"a": {"is_external": true, "steps": 1, "0": {"prompt": "P {}", "next_step": "N"}, "info": "i"},'
            ' "b": {"steps": 2, "0": {"prompt": "x", "next_step": ""}, "1": {"prompt": "y", "next_step": "z"}}}')
    prompts = parse_prompts(spark.createDataFrame([(body,)], "value STRING"))
    assert [tuple(s) for s in prompt_named(prompts, "b")] == [("x", ""), ("y", "z")]
    with pytest.raises(UnknownPrompt):
        prompt_named(prompts, "c")


def test_top_words_ties_go_to_first_seen(spark):
    df = spark.createDataFrame([(0, "b x"), (1, "a"), (2, "A b"), (3, "B"), (4, "c")], "pos BIGINT, question STRING")
    rows = report.top_words(df, n=2).collect()
    assert [(r["word"], r["n"], r["pct"]) for r in rows] == [("B", 2, 40.0), ("A", 2, 40.0)]


def test_score_sheet_leaves_blanks(spark):
    rows = [("cos_sim_m", "nq", "NDCG@10", 40.0), ("cos_sim_m", "fiqa", "NDCG@10", 20.0), ("x", "nq", "MRR@10", 1.0)]
    df = spark.createDataFrame(rows, "model STRING, dataset STRING, metric STRING, value DOUBLE")
    sheet = report.score_sheet(df, "NDCG@10", ["msmarco", "nq", "fiqa"]).collect()
    assert [tuple(r) for r in sheet] == [("cos_sim_m", "cos_sim", 30.0, None, 40.0, 20.0)]
