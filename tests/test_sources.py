import json

import pytest
from pyspark.sql import functions as F

from pairloom import schemas
from pairloom.operators.pairs import Collection, UnknownId, join_pairs, join_sup, skipped_documents
from pairloom.sources import collections, files, outputs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_ids_and_bad_lines(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", '{"_id": 7, "title": "t", "text": "x"}\n{"_id": "8", "text": "y"}\n')
    rows = files.read_corpus(spark, path).orderBy("pos").collect()
    assert [(r["_id"], r["title"], r["text"]) for r in rows] == [("7", "t", "x"), ("8", None, "y")]
    bad = write(tmp_path / "bad.jsonl", '{"_id": 1}\n{oops\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, bad, schemas.QUERIES).collect()


def test_file_order_over_files_and_splits(spark, tmp_path):
    """Sizes are such that the reader packs the files out of order and splits the large one."""
    n = 0
    for name, rows in (("a", 3), ("b", 4000), ("c", 10)):
        lines = [json.dumps({"_id": str(n + i), "text": "x" * 50}) for i in range(rows)]
        write(tmp_path / "q" / f"{name}.jsonl", "\n".join(lines) + "\n")
        n += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "3000")
    try:
        rows = files.read_queries(spark, str(tmp_path / "q")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["_id"] for r in sorted(rows, key=lambda r: r["pos"])] == [str(i) for i in range(n)]
    assert len({r["pos"] for r in rows}) == n


def test_json_array_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("_id"), F.lit('a "b"\n').alias("text")).repartition(3)
    path = str(tmp_path / "arrays.json")
    files.write_json_array(df, path)
    parts = [json.loads(p.read_text()) for p in (tmp_path / "arrays.json").glob("part-*")]
    assert sum(map(len, parts)) == 50
    lines = files.json_to_jsonl(spark, path, schemas.QUERIES)
    assert lines == path + "l"
    back = files.read_queries(spark, lines, ordered=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("file_bytes", [1, 300, 2000, 1 << 20])
def test_json_arrays_are_cut_into_files(spark, tmp_path, file_bytes):
    """One task's rows go to files of bounded size, each an array of its own, in the order of the rows."""
    df = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("_id"), F.concat(
        F.lit('"é\n'), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "arrays.json")
    files.write_json_array(df, path, file_bytes=file_bytes)
    found = sorted((tmp_path / "arrays.json").glob("part-*"))
    parts = [json.loads(p.read_text()) for p in found]
    assert all(parts) and [r["_id"] for part in parts for r in part] == [str(i) for i in range(300)]
    longest = max(len(line.encode()) for p in found for line in p.read_text().splitlines())
    assert all(p.stat().st_size <= max(file_bytes, 16 * (longest + 2)) + 32 for p in found)
    assert len(found) >= sum(p.stat().st_size for p in found) / (max(file_bytes, 16 * (longest + 2)) + 32)
    back = files.read_json(spark, path, schemas.QUERIES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_qrels_last_row_wins(spark, tmp_path):
    path = write(tmp_path / "test.tsv", "query-id\tcorpus-id\tscore\nq\td\t1\nq\te\t2\nq\td\t0\n")
    rows = collections.read_qrels(spark, path).orderBy("pos").collect()
    assert [(r["query_id"], r["corpus_id"], r["score"]) for r in rows] == [("q", "d", 0), ("q", "e", 2)]


def test_qrels_further_columns_and_bad_grades(spark, tmp_path):
    path = write(tmp_path / "test.tsv", "query-id\tcorpus-id\tscore\tnote\nq\td\t1\tx\nq\te\t2\nq\tf\t3\ty\tz\n")
    rows = collections.read_qrels(spark, path).orderBy("pos").collect()
    assert [(r["query_id"], r["corpus_id"], r["score"]) for r in rows] == [("q", "d", 1), ("q", "e", 2), ("q", "f", 3)]
    for line in ("q\td\n", "q\td\tgood\n"):
        bad = write(tmp_path / f"bad{len(line)}.tsv", "query-id\tcorpus-id\tscore\n" + line)
        with pytest.raises(Exception):
            collections.read_qrels(spark, bad).collect()


def test_file_order_of_two_thousand_files(spark, tmp_path):
    for i in range(2000):
        write(tmp_path / "q" / f"{i:04d}.jsonl", json.dumps({"_id": str(2 * i)}) + "\n" + json.dumps({"_id": str(2 * i + 1)}) + "\n")
    rows = files.read_queries(spark, str(tmp_path / "q"))
    plan = rows._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert [int(r["_id"]) for r in sorted(rows.collect(), key=lambda r: r["pos"])] == list(range(4000))


def collection(spark, tmp_path, split="test"):
    write(tmp_path / "corpus.jsonl", "".join(
        json.dumps({"_id": f"d{i}", "title": f"t{i}", "text": f"x{i}"}) + "\n" for i in range(5)))
    write(tmp_path / "queries.jsonl", "".join(
        json.dumps({"_id": f"q{i}", "text": f"ask{i}"}) + "\n" for i in range(6)))
    write(tmp_path / "qrels" / f"{split}.tsv",
          "query-id\tcorpus-id\tscore\nq0\td0\t1\nq0\td1\t0\nq4\td4\t2\nq4\tgone\t1\n")
    return collections.load_collection(spark, str(tmp_path), split)


def test_load_keeps_judged_queries(spark, tmp_path):
    data = collection(spark, tmp_path)
    assert sorted(r["_id"] for r in data.queries.collect()) == ["q0", "q4"]


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_pairs_skip_missing_documents(spark, tmp_path, hot_rows):
    data = collection(spark, tmp_path)
    pairs = join_pairs(data, 1, hot_rows=hot_rows).collect()
    assert sorted((r["guid"], r["query"], r["doc"], r["label"]) for r in pairs) == [
        (0, "ask0", "t0 x0", 1), (1, "ask4", "t4 x4", 1)]
    assert [r[0] for r in skipped_documents(data.qrels, data.corpus).collect()] == ["gone"]


def test_supervised_records_keep_grade_zero(spark, tmp_path):
    data = collection(spark, tmp_path)
    with pytest.raises(UnknownId):
        join_sup(data, "set")
    known = Collection(data.corpus, data.queries, data.qrels.filter("corpus_id <> 'gone'"))
    scores = sorted(r["positive_ctxs"][0]["score"] for r in join_sup(known, "set").collect())
    assert scores == [0, 1, 2]


def test_paths_and_split_rule():
    assert outputs.generated_path("out", "nq", "LLM", "org/m") == "out/nq/LLM_org_m"
    assert outputs.shards_path("out/nq/LLM_org_m", "dev") == "out/nq/shards/dev"
    assert outputs.training_path("out", "cos_sim", "nq", "LLM", "base", "org/m", True) == (
        "out/nq/cos_sim_dpr_nq_LLM_org_m_pretrained_on_base")
    assert [collections.evaluation_split(x) for x in ("msmarco", "nq")] == ["dev", "test"]


def test_results_round_trip(spark, tmp_path):
    rows = [("a/b", "cqadupstack/tex", "NDCG", 10, 41.5), ("a/b", "cqadupstack/tex", "MRR", 10, 3.0)]
    df = spark.createDataFrame(rows, "model STRING, dataset STRING, metric STRING, k INT, value DOUBLE")
    outputs.write_results(df, str(tmp_path / "r"))
    got = sorted(map(tuple, outputs.read_results(spark, str(tmp_path / "r")).collect()))
    assert got == [("a_b", "cqadupstack_tex", "MRR@10", 3.0), ("a_b", "cqadupstack_tex", "NDCG@10", 41.5)]


def test_score_card(spark, tmp_path):
    card = [{"model name": "m", "algorithm": "", "trained on": "", "metrics": {"NDCG@10": {"nq": 25.4, "fiqa": ""}}}]
    path = write(tmp_path / "card.json", json.dumps(card))
    rows = outputs.score_card(files.read_json(spark, path, schemas.SCORE_CARD)).collect()
    assert sorted((r["model"], r["metric"], r["dataset"], r["value"]) for r in rows) == [
        ("m", "NDCG@10", "fiqa", None), ("m", "NDCG@10", "nq", 25.4)]


def test_prompt_of_any_number_of_steps(spark):
    import json

    from pairloom.sources.prompts import parse_prompts

    body = {"is_external": True, "info": "i", "steps": 12} | {
        str(k): {"prompt": f"p{k}", "next_step": f"n{k}"} for k in range(12)}
    text = json.dumps({"long": body, "short": {"steps": 1, "0": {"prompt": "a", "next_step": "b"}}})
    rows = {r["name"]: r for r in parse_prompts(spark.createDataFrame([(text,)], "value string")).collect()}
    assert [s["prompt"] for s in rows["long"]["steps"]] == [f"p{k}" for k in range(12)]
    assert rows["long"]["is_external"] and len(rows["short"]["steps"]) == 1


def test_broken_off_shards_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/shards"
    (tmp_path / "shards" / "_temporary").mkdir(parents=True)
    outputs.write_shards(spark.range(10).selectExpr("id AS pos", "CAST(id % 2 AS INT) AS shard_id"), path)
    assert outputs.read_shards(spark, path, "pos BIGINT").count() == 10
    outputs.write_shards(spark.range(3).selectExpr("id AS pos", "0 AS shard_id"), path)
    assert outputs.read_shards(spark, path, "pos BIGINT").count() == 10
