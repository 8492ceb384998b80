"""Whole flows from a corpus to exported pairs."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from threading import Event, Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom import schemas
from pairloom.functions.crop import crop_pair
from pairloom.operators import generate as gen, postprocess as post, sampling
from pairloom.operators.pairs import Collection, join_sup, sup_info
from pairloom.session import materialize
from pairloom.sources import files, outputs
from pairloom.sources.collections import write_qrels


def cropped_pairs(corpus: DataFrame, seed: int, ratio: float = 1.0,
                  questions_per_document: int = 1, salt: str = "sample") -> DataFrame:
    """Exact sample, copies, two crops per copy, all without a shuffle of texts."""
    sampled = corpus if ratio == 1.0 else sampling.sample_exact(
        corpus, ratio=ratio, seed=seed, salt=salt)
    copies = sampling.copies_in_place(sampled, questions_per_document)
    return crop_pair(copies.select("pos", "_id", "text"), seed)


def crop_splits(corpus: DataFrame, seed: int, ratio: float = 1.0, dev_ratio: float | None = None,
                questions_per_document: int = 1) -> dict[str, DataFrame]:
    """Train pairs and, if asked for, dev pairs drawn from the full corpus."""
    splits = {"train": cropped_pairs(corpus, seed, ratio, questions_per_document)}
    if dev_ratio:
        splits["dev"] = cropped_pairs(corpus, seed + 1, dev_ratio, questions_per_document, "dev")
    return splits


SHARDS_AT_ONCE = 8


def generate_missing(spark: SparkSession, corpus: DataFrame, root: str, dataset: str, model: str,
                     steps: list[gen.Step], factory: gen.GeneratorFactory, shard_size: int,
                     prompt: str = "standard", split: str = "train", seed: int = 0,
                     ratio: float = 1.0, questions_per_document: int = 1,
                     shards_at_once: int = SHARDS_AT_ONCE, optimization: bool = False, do_sample: bool = False,
                     p: float = 1.0, **batching) -> None:
    """Shard the corpus, generate for the shards without output, write output and run facts.

    Run it again after an interruption: finished shards are left alone, shards with an error have
    no output and are generated again. Each shard is committed on its own, its output before the record that
    tells of it, so an interruption costs the shards that are at work: ``shards_at_once``, as many Spark jobs side by
    side. The driver holds shard numbers only.
    """
    target = outputs.generated_path(root, dataset, "LLM", model)
    shards = outputs.shards_path(target, split)
    sampled = corpus if ratio == 1.0 else sampling.sample_exact(
        corpus, ratio=ratio, seed=seed, salt=f"sample-{split}")
    copies = sampling.replicate_k(
        sampled.select("pos", "_id", "text"), questions_per_document, seed=seed)
    rows = sampled.count() * questions_per_document
    outputs.write_shards(sampling.shard_assign(copies, shard_size, rows=rows), shards)

    done_path, facts_path = f"{target}/{split}/pairs", f"{target}/{split}/metadata"
    todo = outputs.read_shards(spark, shards, "pos BIGINT, _id STRING, text STRING")
    missing = sampling.shard_missing(todo, finished_shards(spark, done_path))
    ids = sorted(row["shard_id"] for row in missing.collect())
    run = gen.RunSettings(dataset, split, model, prompt, target, optimization, do_sample, p,
                          outputs.next_run(spark, facts_path))

    def generate(shard: int) -> None:
        start = datetime.now().isoformat(" ", "microseconds")
        made = gen.prompt_steps(gen.prepare_documents(todo.filter(F.col("shard_id") == shard), "text"), steps,
                                factory, **batching)
        made = materialize(made.select(  # the model runs once, all else reads its output
            "pos", "query", "document", "document_processed", "shard_id", "errors",
            "seconds_total", "batch_size"), "shard")
        facts = materialize(gen.run_facts(made, run, start), "facts")
        if facts.first()["errors"] == 0:
            outputs.write_generated(made.select("pos", "query", "document", "document_processed", "shard_id"),
                                    done_path)
        with one_append:  # two jobs that append to one folder clear away each other's temporary files
            outputs.append_facts(facts.coalesce(1), facts_path)

    one_append, broken = Lock(), Event()

    def attempt(shard: int) -> None:
        if broken.is_set():
            return
        try:
            generate(shard)
        except BaseException:
            broken.set()
            raise

    with ThreadPoolExecutor(max(1, shards_at_once)) as pool:
        list(pool.map(attempt, ids))  # a failure is raised when the shards at work are done; no other is begun


def finished_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shard ids with output; none if nothing was written yet."""
    try:
        return outputs.read_shards(spark, path, "pos BIGINT").select("shard_id").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "shard_id INT")


def export_split(pairs: DataFrame, corpus: DataFrame, document: str, exclude: list[str] | None,
                 path: str, split: str, query_offset: int = 0) -> int:
    """Queries and judgements of the valid pairs, and the loss counts of the split.

    ``pairs`` is a written table, it is read several times. Returns the number of queries.
    """
    numbered = materialize(post.numbered_pairs(pairs, corpus, document, exclude, query_offset), "numbered")
    files.write_json(post.export_queries(numbered), f"{path}/queries.jsonl/split={split}")
    write_qrels(post.export_qrels(numbered), f"{path}/qrels/{split}.tsv")
    status = post.post_status(pairs, corpus, document, exclude)
    files.write_json(post.agg_loss(status, corpus), f"{path}/qrels/{split}_info.json")
    return numbered.count()


def next_query(spark: SparkSession, path: str, splits: list[str]) -> int:
    """The first free query number beside those of other splits that are exported already."""
    try:
        old = spark.read.schema("_id STRING, split STRING").json(path)
    except AnalysisException:  # nothing was exported yet
        return 0
    last = old.filter(~F.col("split").isin(splits)).agg(F.max(F.col("_id").cast("long"))).first()[0]
    return 0 if last is None else last + 1


def export_generated(splits: dict[str, DataFrame], corpus: DataFrame, path: str, dataset: str,
                     method: str, model: str = "", nested: bool = True,
                     exclude: list[str] | None = None) -> None:
    """Clean and export generated splits.

    ``nested`` writes pair records per split; else queries, judgements and the corpus, with query
    numbers that run on over the splits, those of earlier calls included. Cropped pairs link by their
    original document and have no leaked answers; generated ones link by their document.
    """
    cropped = method == "cropping"
    document = "original_document" if cropped else "document"
    excluded = None if cropped else (post.FEW_SHOT_ANSWERS if exclude is None else exclude)
    spark = corpus.sparkSession
    offset = 0 if nested else next_query(spark, f"{path}/beir/queries.jsonl", list(splits))
    for split, pairs in splits.items():
        if nested:
            valid = post.valid_pairs(pairs, corpus, document, excluded)
            records = post.export_pairs(valid, dataset, method, model).drop("pos")
            files.write_json(records, f"{path}/dpr/{split}_dpr.json")
            status = post.post_status(pairs, corpus, document, excluded)
            files.write_json(post.agg_loss(status, corpus), f"{path}/dpr/{split}_dpr_info.json")
        else:
            offset += export_split(pairs, corpus, document, excluded, f"{path}/beir", split, offset)
    if not nested:
        files.write_json(corpus.drop("pos"), f"{path}/beir/corpus.jsonl")


def export_supervised(data: Collection, path: str, dataset: str, split: str) -> None:
    """Pair records of a judged collection and their counts."""
    files.write_json(join_sup(data, dataset).drop("query_id"), f"{path}/dpr/{split}_dpr.json")
    files.write_json(sup_info(data.qrels), f"{path}/dpr/{split}_dpr_info.json")


GENERATED = "pos BIGINT, query STRING, document STRING, document_processed STRING"


def export_finished(spark: SparkSession, corpus: DataFrame, root: str, dataset: str, model: str, splits: list[str],
                    path: str, exclude: list[str] | None = None) -> DataFrame:
    """Clean and export what ``generate_missing`` wrote for ``splits``, all or nothing.

    Refuses (:class:`IncompleteShards`) while a shard of any of the splits has no output. Every split is
    written to a folder of its own that nobody reads yet; when all are complete, one appended record
    switches to them. A break before it leaves the exports of earlier calls valid. Query numbers go on behind those
    of the other splits' valid exports. Returns the valid exports (:func:`outputs.read_exports`).
    """
    target = outputs.generated_path(root, dataset, "LLM", model)
    for split in splits:
        shards = outputs.read_shards(spark, outputs.shards_path(target, split), "pos BIGINT")
        sampling.require_complete(shards, finished_shards(spark, f"{target}/{split}/pairs"))
    held = outputs.read_exports(spark, path).collect()  # one row per split
    offset = max((r["first_query"] + r["queries"] for r in held if r["split"] not in splits), default=0)
    run = max((r["run"] for r in held), default=-1) + 1
    rows = []
    for split in splits:
        folder = f"{path}/{split}-{uuid.uuid4().hex}"
        pairs = outputs.read_shards(spark, f"{target}/{split}/pairs", GENERATED)
        n = export_split(pairs, corpus, "document", post.FEW_SHOT_ANSWERS if exclude is None else exclude,
                         folder, split, offset)
        rows.append((run, split, folder, offset, n))
        offset += n
    files.write_json(corpus.drop("pos"), f"{path}/corpus-{run}.jsonl")
    outputs.commit_exports(spark, path, rows)
    return outputs.read_exports(spark, path)


def exported_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of all valid exports."""
    folders = [r["folder"] for r in outputs.read_exports(spark, path).collect()]  # one row per split
    parts = [files.read_queries(spark, f"{f}/queries.jsonl", ordered=False).select("_id", "text") for f in folders]
    if not parts:
        return spark.createDataFrame([], schemas.QUERIES)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
