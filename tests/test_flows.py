"""Generation with retries and resume, incremental generation, whole flows."""

import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import generate as gen
from pairloom.operators.encode import hashed_words
from pairloom.operators.pairs import Collection
from pairloom.operators.report import COLLECTIONS, SUB_FORUMS, history_columns, score_sheet
from pairloom.operators.sampling import IncompleteShards
from pairloom.plans import build, evaluate, train
from pairloom.sources import files, outputs
from pairloom.sources.prompts import builtin_prompts
from pairloom.streaming.resume import corpus_stream, crop_stream


def test_retry_shrinks_the_batch_then_gives_up():
    sizes = []

    def model(prompts):
        sizes.append(len(prompts))
        if len(prompts) > 40 or "bad" in prompts:
            raise MemoryError
        return [p + "!" for p in prompts]

    texts, errors, size = gen.complete_batches(["x"] * 70, model)
    assert (texts, errors, size) == (["x!"] * 70, [0] * 70, 32) and sizes == [64, 48, 32, 32, 6]
    texts, errors, _ = gen.complete_batches(["bad", "y"], model, batch_size=1, step=1)
    assert texts == [None, "y!"] and errors == [1, 0]


def documents(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").alias("pos"), F.col("id").cast("string").alias("_id"),
        F.concat(F.lit("short words and looooong"), F.col("id").cast("string")).alias("text"))


class FailsOnSeven(gen.LongestWord):
    def __call__(self, prompts):
        if any("looooong7\n" in p for p in prompts):
            raise RuntimeError
        return super().__call__(prompts)


def test_generate_and_resume(spark, tmp_path):
    root, steps = str(tmp_path / "out"), builtin_prompts()["standard"]
    run = lambda model: build.generate_missing(
        spark, documents(spark, 40), root, "set", "org/m", steps, model, shard_size=10, batch_size=1,
        shards_at_once=3)
    run(FailsOnSeven)
    done = f"{root}/set/LLM_org_m/train/pairs"
    schema = "pos BIGINT, query STRING, document STRING, document_processed STRING"
    first = outputs.read_shards(spark, done, schema)
    assert first.count() == 30 and first.select("shard_id").distinct().count() == 3
    facts = outputs.read_facts(spark, f"{root}/set/LLM_org_m/train/metadata")
    assert sorted(r["errors"] for r in facts.collect()) == [0, 0, 0, 1]
    assert facts.filter("errors = 1").first()["time_in_minutes"] is None

    run(gen.LongestWord)  # only the failed shard is left
    rows = outputs.read_shards(spark, done, schema).collect()
    assert len(rows) == 40
    assert all(r["query"] == r["document"].split()[-1] for r in rows)
    facts = outputs.read_facts(spark, f"{root}/set/LLM_org_m/train/metadata")
    assert [r["errors"] for r in facts.collect()] == [0, 0, 0, 0]  # the failed shard's record is replaced


FACTS = {"dataset_name": "set", "split": "train", "model_name": "org/m", "optimization": True, "do_sample": True,
         "p": 0.9, "prompt_name": "standard", "errors": 0, "batch_size": 7, "run": 0}


def test_all_run_facts_are_written(spark, tmp_path):
    root = str(tmp_path / "out")
    build.generate_missing(spark, documents(spark, 20), root, "set", "org/m", builtin_prompts()["standard"],
                           gen.LongestWord, shard_size=10, optimization=True, do_sample=True, p=0.9, batch_size=7)
    rows = outputs.read_facts(spark, f"{root}/set/LLM_org_m/train/metadata").collect()
    assert sorted(r["shard_id"] for r in rows) == [0, 1]
    for r in rows:
        assert None not in r and {k: r[k] for k in FACTS} == FACTS
        assert r["save_path"] == f"{root}/set/LLM_org_m" and r["this_file_path"] == r["save_path"] + "/train/metadata"
        assert r["time_start"] <= r["time_end"]
    shards = [p for p in (tmp_path / "out" / "set" / "LLM_org_m" / "train" / "pairs").glob("shard_id=*")]
    assert len(shards) == 2 and all(len(list(p.glob("*.parquet"))) == 1 for p in shards)


def test_a_break_costs_the_shards_at_work(spark, tmp_path, monkeypatch):
    """Output of a shard stands before its record; a break in between has it generated again."""
    root, steps = str(tmp_path / "out"), builtin_prompts()["standard"]
    run = lambda: build.generate_missing(spark, documents(spark, 40), root, "set", "org/m", steps, gen.LongestWord,
                                         shard_size=10, shards_at_once=1)
    append, seen = outputs.append_facts, []

    def breaks(df, path):
        seen.append(1)
        if len(seen) == 3:
            raise KeyboardInterrupt
        append(df, path)

    monkeypatch.setattr(outputs, "append_facts", breaks)
    with pytest.raises(KeyboardInterrupt):
        run()
    done = f"{root}/set/LLM_org_m/train/pairs"
    assert build.finished_shards(spark, done).count() == 3
    monkeypatch.setattr(outputs, "append_facts", append)
    run()
    assert spark.read.parquet(done).count() == 40


def test_export_of_finished_shards(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path / "out"), str(tmp_path / "export")
    corpus = documents(spark, 30).withColumn("title", F.lit("t"))
    make = lambda model, split: build.generate_missing(
        spark, corpus, root, "set", "org/m", builtin_prompts()["standard"], model, shard_size=10, batch_size=1, split=split)
    export = lambda *splits: build.export_finished(spark, corpus, root, "set", "org/m", list(splits), path)
    make(FailsOnSeven, "train")
    with pytest.raises(IncompleteShards):
        export("train")
    assert outputs.read_exports(spark, path).count() == 0
    make(gen.LongestWord, "train")
    export("train")
    numbers = lambda: sorted(int(r["_id"]) for r in build.exported_queries(spark, path).collect())
    assert numbers() == list(range(30))
    make(gen.LongestWord, "dev")

    def breaks(*_):
        raise OSError("half way")

    commit = outputs.commit_exports
    monkeypatch.setattr(outputs, "commit_exports", breaks)
    with pytest.raises(OSError):
        export("dev")
    assert numbers() == list(range(30))  # what the broken call wrote is not read
    monkeypatch.setattr(outputs, "commit_exports", commit)
    rows = {r["split"]: r["first_query"] for r in export("dev").collect()}
    assert rows == {"train": 0, "dev": 30} and numbers() == list(range(60))
    export("train")  # again: behind the other split
    assert numbers() == list(range(30, 90))


def test_two_step_prompt(spark):
    made = gen.prompt_steps(gen.prepare_documents(documents(spark, 3)), builtin_prompts()["title"], gen.LongestWord)
    assert all(r["out_0"] == r["document"].split()[-1] for r in made.collect())


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    step = lambda: crop_stream(corpus_stream(spark, source, "_id STRING, text STRING"), out, checkpoint, 1)
    for start in (0, 5):
        documents(spark, 5, start).select("_id", "text").write.mode("append").json(source)
        step()
        step()
        assert spark.read.parquet(out).count() == start + 5
    assert spark.read.parquet(out).select("_id").distinct().count() == 10


def test_streamed_pairs_are_numbered_and_a_replay_changes_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    stream = lambda: corpus_stream(spark, source, "_id STRING, text STRING")
    corpus = documents(spark, 12).withColumn("title", F.lit("t"))
    for part in range(3):
        documents(spark, 4, 4 * part).select("_id", "text").write.mode("append").json(source)
        crop_stream(stream(), out, checkpoint, 1)
    rows = sorted(map(str, spark.read.parquet(out).collect()))
    assert sorted(r["pos"] for r in spark.read.parquet(out).collect()) == list(range(12))
    for name in ("2", ".2.crc"):  # as if the last batch broke off before its commit
        (tmp_path / "check" / "commits" / name).rename(tmp_path / f"kept{name}")
    crop_stream(stream(), out, checkpoint, 1)
    assert sorted(map(str, spark.read.parquet(out).collect())) == rows
    pairs = spark.read.parquet(out).drop("batch_id")
    build.export_generated({"train": pairs}, corpus, str(tmp_path / "x"), "set", "cropping", nested=False)
    info = json.loads(next((tmp_path / "x" / "beir" / "qrels" / "train_info.json").glob("part-*.json")).read_text())
    assert info["without_post"] == 12 and info["lost_not_found"] == 0


def test_crop_splits_and_export(spark, tmp_path):
    corpus = documents(spark, 60).withColumn("title", F.lit("t"))
    corpus = corpus.withColumn("text", F.concat_ws(" ", "text", "text", "text", "text", "text"))
    splits = build.crop_splits(corpus, seed=1, ratio=0.5, dev_ratio=0.25, questions_per_document=3)
    assert {n: s.count() for n, s in splits.items()} == {"train": 90, "dev": 45}
    assert splits["train"].select("pos").distinct().count() == 90
    pairs = splits["train"].withColumn("_path", F.lit(0)).drop("_path")
    build.export_split(pairs, corpus, "original_document", None, str(tmp_path / "x"), "train", query_offset=100)
    queries = files.read_queries(spark, str(tmp_path / "x" / "queries.jsonl"), ordered=False)
    assert sorted(int(r["_id"]) for r in queries.collect()) == list(range(100, 130))
    info = json.loads(next((tmp_path / "x" / "qrels" / "train_info.json").glob("part-*.json")).read_text())
    assert info["with_post"] == 30 and info["without_post"] == 90 and info["corpus_length"] == 60


def test_search_texts_finds_the_same_text(spark):
    corpus = documents(spark, 30).select(F.lit("s").alias("dataset"), "_id", F.lit("").alias("title"), "text")
    queries = corpus.select("dataset", F.concat(F.lit("q"), "_id").alias("_id"), "text")
    run = evaluate.search_texts(queries, corpus, hashed_words(512), k=3)
    best = run.filter("rank = 1 AND score_fn = 'cos_sim'").collect()
    assert len(best) == 30 and all(r["score"] == pytest.approx(1.0) for r in best)
    qrels = corpus.select("dataset", F.concat(F.lit("q"), "_id").alias("query_id"), F.col("_id").alias("corpus_id"), F.lit(1).alias("score"))
    binary, graded = evaluate.measure(run, qrels, k_values=[1, 3])
    value = lambda df, m, k: df.filter(f"metric = '{m}' AND k = {k} AND score_fn = 'cos_sim'").first()["value"]
    assert value(binary, "accuracy", 3) == pytest.approx(value(graded, "Recall", 3), abs=1e-5)


@pytest.fixture
def talk(spark):
    """Ten documents, five queries; query i is about document i, query 4 only has a grade 0."""
    corpus = documents(spark, 10).withColumn("title", F.lit("t"))
    queries = documents(spark, 5).withColumn("_id", F.concat(F.lit("q"), "_id"))
    grade = F.when(F.col("pos") == 4, 0).otherwise(1)
    qrels = queries.select(F.col("_id").alias("query_id"), F.col("pos").cast("string").alias("corpus_id"),
                           grade.alias("score"), "pos")
    return Collection(corpus, queries, qrels)


def test_training_batches_and_development_set(spark, talk):
    rows = train.training_batches(talk, 2, dual=True).collect()
    assert len(rows) == 4 and sorted(r["batch_id"] for r in rows) == [0, 0, 1, 1]
    assert all(r["doc"]["doc"] == "t [SEP] " + r["query"]["query"] for r in rows)
    dev = train.development_set(talk, max_corpus_size=6)
    assert dev.queries.count() == 4 and dev.corpus.count() == 6 and dev.qrels.count() == 4
    with pytest.raises(ValueError):
        train.development_set(talk._replace(queries=talk.queries.limit(0)))


def test_development_evaluation(spark, tmp_path, talk):
    dev = train.development_set(talk, max_corpus_size=6)
    path = str(tmp_path / "history")
    cuts = {"accuracy": [1], "precision": [1], "recall": [1], "mrr": [10], "ndcg": [3, 10], "map": [10]}
    own = lambda epoch, fn: train.evaluate_development(dev, hashed_words(512), path, epoch, 5, cuts=cuts, dim=512,
                                                       main_score_fn=fn)
    assert 0 < own(0, "cos_sim") <= own(1, None) <= 1
    rows = outputs.read_history(spark, path, history_columns(["cos_sim", "dot_score"], cuts)).orderBy("epoch").collect()
    assert [(r["epoch"], r["steps"]) for r in rows] == [(0, 5), (1, 5)] and None not in rows[1]


def test_triplet_flow(spark):
    rows = documents(spark, 50).select("pos", F.col("_id").alias("q"), "text", F.lit("same").alias("n"))
    got = train.triplet_batches(rows, 8, "q", "text", "n").collect()
    assert len(got) == 50 == len({r["batch_id"] for r in got})  # one negative for all: a batch each


def test_report_over_result_files(spark, tmp_path):
    """Fifteen collections and twelve sub-forums, one of them missing for the second model."""
    path = str(tmp_path / "results")
    rows = [(m, d, metric, k, 10.0 * i) for m in ("a_cos_sim", "b") for i, d in enumerate(
        [c for c in COLLECTIONS if c != "cqadupstack"] + [f"cqadupstack/{s}" for s in SUB_FORUMS])
        for metric, k in (("NDCG", 10), ("Recall", 100), ("MRR", 10), ("MAP", 5)) if (m, d) != ("b", "cqadupstack/tex")]
    frame = spark.createDataFrame(rows, "model STRING, dataset STRING, metric STRING, k INT, value DOUBLE")
    for model in ("a_cos_sim", "b"):  # the second call leaves the first model's files alone
        evaluate.write_evaluation(frame.filter(F.col("model") == model), path)
    sheets = {(r["metric"], r["model"]): r.asDict() for r in evaluate.report(spark, path).collect()}
    assert len(sheets) == 6
    a, b = sheets["NDCG@10", "a_cos_sim"], sheets["MRR@10", "b"]
    assert list(a) == ["metric", "model", "similarity", "average", *COLLECTIONS, *[f"cqadupstack_{s}" for s in SUB_FORUMS]]
    assert a["cqadupstack"] == sum(10.0 * (14 + i) for i in range(12)) / 12 and a["similarity"] == "cos_sim"
    assert b["cqadupstack"] is None and b["cqadupstack_tex"] is None and b["fiqa"] == 50.0


def test_sheet_columns_come_from_the_data(spark):
    rows = spark.createDataFrame([("m", f"turn{i}", "x", float(i)) for i in (0, 3, 40)], "model STRING, dataset STRING, metric STRING, value DOUBLE")
    (row,) = score_sheet(rows, "x").collect()
    assert row.asDict() == {"model": "m", "similarity": "", "average": 43 / 3, "turn0": 0.0, "turn3": 3.0, "turn40": 40.0}


def test_evaluate_model_to_sheet(spark, talk):
    names = [f"cqadupstack/{i}" for i in range(12)] + ["nq"]
    each = lambda df: df.withColumn("dataset", F.explode(F.array(*[F.lit(n) for n in names])))
    rows = evaluate.evaluate_model(each(talk.queries), each(talk.corpus), each(talk.qrels), "cos_sim_m",
                                   hashed_words(512), "cos_sim", k_values=[1, 10], dim=512)
    rows = rows.withColumn("metric", F.concat_ws("@", "metric", "k"))
    sheet = score_sheet(rows, "Recall@1", ["cqadupstack", "nq", "fiqa"]).collect()
    assert [tuple(r) for r in sheet] == [("cos_sim_m", "cos_sim", 80.0, 80.0, 80.0, None)]


@pytest.mark.parametrize("nested", [True, False])
def test_export_generated(spark, tmp_path, nested):
    corpus = documents(spark, 6).withColumn("title", F.lit("t"))
    pairs = corpus.select("pos", F.lit("What fruit is native to Australia?").alias("query"), F.col("text").alias("document"))
    good = pairs.withColumn("query", F.lit("ask")).filter("pos < 4")
    build.export_generated({"train": good, "dev": good, "rest": pairs}, corpus, str(tmp_path), "set", "LLM", "org/m", nested)
    if nested:
        rows = spark.read.json(str(tmp_path / "dpr" / "dev_dpr.json"))
        assert rows.count() == 4 and rows.first()["dataset"] == "set_unsupervised_LLM_org_m"
        info = json.loads(next((tmp_path / "dpr" / "rest_dpr_info.json").glob("part-*.json")).read_text())
        assert info["lost_same_prompt_answer"] == 6
    else:
        queries = files.read_queries(spark, str(tmp_path / "beir" / "queries.jsonl"), ordered=False)
        assert sorted(int(r["_id"]) for r in queries.collect()) == list(range(8))
        for split in ("late", "train"):  # a later call goes on behind the splits it does not write
            build.export_generated({split: good}, corpus, str(tmp_path), "set", "LLM", "org/m", nested)
        queries = files.read_queries(spark, str(tmp_path / "beir" / "queries.jsonl"), ordered=False)
        assert sorted(int(r["_id"]) for r in queries.collect()) == list(range(4, 16))
        assert files.read_corpus(spark, str(tmp_path / "beir" / "corpus.jsonl")).count() == 6


def test_export_supervised(spark, tmp_path, talk):
    build.export_supervised(talk, str(tmp_path), "set", "train")
    assert spark.read.json(str(tmp_path / "dpr" / "train_dpr.json")).count() == 5
