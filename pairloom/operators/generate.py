"""Text generation with a pluggable model: prompt steps, batches, retries, run facts.

The user gives a factory ``() -> (list[str] -> list[str])``, called once per task. The function
returns completions that echo their prompt, as causal language models do.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairloom.functions.text import answer_extract, ascii_strip, doc_truncate, prompt_build

Generator = Callable[[list[str]], list[str]]
GeneratorFactory = Callable[[], Generator]

# Fixed defaults of the generation runs.
BATCH_SIZE = 64
BATCH_SIZE_STEP = 16
TRIES = 3


class Step(NamedTuple):
    prompt: str
    next_step: str


def complete_batches(prompts: list[str], model: Generator, batch_size: int = BATCH_SIZE,
                     step: int = BATCH_SIZE_STEP, tries: int = TRIES):
    """Completions, error flags and the batch size in the end.

    A failing batch is tried again with a batch size smaller by ``step`` (1 at least). After
    ``tries`` failures its rows get no completion and error 1, and the run goes on.
    """
    done: list[str | None] = []
    errors: list[int] = []
    failures = 0
    while len(done) < len(prompts):
        part = prompts[len(done):len(done) + batch_size]
        try:
            answers = list(model(part))
            if len(answers) != len(part):
                raise ValueError(f"{len(answers)} completions for {len(part)} prompts")
            done += answers
            errors += [0] * len(part)
            failures = 0
        except Exception:  # the model is foreign code: any failure counts as one try
            failures += 1
            if failures >= tries:
                done += [None] * len(part)
                errors += [1] * len(part)
                failures = 0
            else:
                batch_size = max(1, batch_size - step)
    return done, errors, batch_size


_TOLD = "completion STRING, error INT, used_batch_size INT, seconds DOUBLE"


def complete(df: DataFrame, factory: GeneratorFactory, prompt: str = "prompt",
             batch_size: int = BATCH_SIZE, step: int = BATCH_SIZE_STEP,
             tries: int = TRIES) -> DataFrame:
    """Adds ``completion``, ``error``, ``used_batch_size`` and ``seconds`` per row.

    Only the prompts travel to Python. ``seconds`` is the row's share of the model time, so sums
    are true run times.
    """

    @F.pandas_udf(_TOLD)
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, size = factory(), batch_size
        for prompts in batches:
            begin = time.perf_counter()
            texts, errors, size = complete_batches(
                prompts.tolist(), model, size, step, tries)
            share = (time.perf_counter() - begin) / max(1, len(prompts))
            yield pd.DataFrame({"completion": texts, "error": errors, "used_batch_size": size,
                                "seconds": share})

    # A model may sample, so its call must not be copied or repeated by the optimizer.
    told = df.withColumn("_told", tell.asNondeterministic()(F.col(prompt)))
    return told.select(*df.columns, "_told.*")


def prepare_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents for prompting: ``document`` is the whole text, ``document_processed`` its first
    2000 characters without non-ASCII ones (cut first, then cleaned)."""
    return df.withColumn("document", F.col(text)).withColumn(
        "document_processed", ascii_strip(doc_truncate(F.col(text))))


def prompt_steps(df: DataFrame, steps: list[Step], factory: GeneratorFactory,
                 compat_drop_last: bool = True, **batching) -> DataFrame:
    """Run the prompt steps; each answer is appended to the inputs of the next step.

    Expects ``document_processed``; the last answer is the ``query``. ``error`` is 1 if any step
    failed for the row.
    """
    out = df.withColumn("errors", F.lit(0)).withColumn("seconds_total", F.lit(0.0))
    values = [F.col("document_processed")]
    for i, step in enumerate(steps):
        asked = out.withColumn("prompt", prompt_build(step.prompt, values, step.next_step))
        told = complete(asked, factory, **batching)
        answer = F.coalesce(
            answer_extract(F.col("completion"), F.col("prompt"), compat_drop_last), F.lit(""))
        out = (told.withColumn(f"out_{i}", answer)
               .withColumn("errors", F.greatest("errors", "error"))
               .withColumn("seconds_total", F.col("seconds_total") + F.col("seconds"))
               .withColumn("batch_size", F.col("used_batch_size"))
               .drop("prompt", "completion", "error", "used_batch_size", "seconds"))
        values.append(F.col(f"out_{i}"))
    return out.withColumn("query", F.col(f"out_{len(steps) - 1}"))


class RunSettings(NamedTuple):
    """What a run records of itself beside what its shards tell."""

    dataset: str
    split: str
    model: str
    prompt: str
    save_path: str = ""
    optimization: bool = False  # the model runs with reduced precision
    do_sample: bool = False
    p: float = 1.0
    run: int = 0  # a later run over the same shards has a higher number


def run_facts(generated: DataFrame, run: RunSettings, time_start: str | None = None) -> DataFrame:
    """One metadata row per shard, all fields written. ``time_in_minutes`` is NULL for a shard with an error."""
    facts = generated.groupBy("shard_id").agg(
        F.max("errors").alias("errors"), F.sum("seconds_total").alias("_s"),
        F.min("batch_size").alias("batch_size"))
    minutes = F.when(F.col("errors") == 0, F.col("_s") / 60)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return facts.select(
        F.lit(run.dataset).alias("dataset_name"), "shard_id", F.lit(run.save_path).alias("save_path"),
        F.lit(f"{run.save_path}/{run.split}/metadata").alias("this_file_path"), F.lit(run.split).alias("split"),
        F.lit(run.model).alias("model_name"), F.coalesce(F.lit(time_start), now).alias("time_start"),
        now.alias("time_end"), minutes.alias("time_in_minutes"), "errors",
        F.lit(run.optimization).alias("optimization"), F.lit(run.do_sample).alias("do_sample"),
        F.lit(float(run.p)).alias("p"), "batch_size", F.lit(run.prompt).alias("prompt_name"),
        F.lit(run.run).cast("long").alias("run"))


class LongestWord:
    """Deterministic stand-in for a language model, for tests and dry runs.

    Echoes the prompt and answers with the longest word (the first of several) of what stands
    between the last ``Document: `` and the end of the prompt.
    """

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            words = prompt[prompt.rfind("Document: ") + len("Document: "):].split()
            out.append(f"{prompt} {max(words, key=len, default='')}\n")
        return out
