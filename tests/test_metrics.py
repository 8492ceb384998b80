import math
import random

import pytest

from pairloom.operators import metrics as met, report

RUN = "dataset STRING, score_fn STRING, query_id STRING, corpus_id STRING, score DOUBLE, rank INT"
QRELS = "dataset STRING, query_id STRING, corpus_id STRING, score INT"
KS = [1, 3, 10]
CUTS = {m: KS for m in ("accuracy", "precision", "recall", "mrr", "ndcg", "map")}


def sample(seed):
    rnd = random.Random(seed)
    run, qrels = [], []
    for q in range(25):
        docs = rnd.sample(range(40), rnd.choice([0, 1, 5, 20]))
        run += [("s", "dot", f"q{q}", f"d{d}", 1.0 / (i + 1), i + 1) for i, d in enumerate(docs)]
        for d in rnd.sample(range(60), rnd.choice([0, 1, 4, 15])):
            qrels.append(("s", f"q{q}", f"d{d}", rnd.choice([0, 0, 1, 2, 3])))
    return run, qrels


def by_query(run, qrels):
    hits, grades = {}, {}
    for _, _, q, d, _, rank in sorted(run, key=lambda r: r[5]):
        hits.setdefault(q, []).append(d)
    for _, q, d, g in qrels:
        grades.setdefault(q, {})[d] = g
    return hits, grades


def dcg(gains):
    return sum(g / math.log2(i + 2) for i, g in enumerate(gains))


def binary_loop(run, qrels):
    hits, grades = by_query(run, qrels)
    relevant = {q: {d for d, g in gs.items() if g >= 1} for q, gs in grades.items()}
    relevant = {q: r for q, r in relevant.items() if r}
    sums = {}
    for q, rel in relevant.items():
        for k in KS:
            flags = [int(d in rel) for d in hits.get(q, [])[:k]]
            first = next((i for i, f in enumerate(flags, 1) if f), None)
            precisions = [sum(flags[:i]) / i for i, f in enumerate(flags, 1) if f]
            values = {
                "accuracy": float(any(flags)), "precision": sum(flags) / k,
                "recall": sum(flags) / len(rel), "mrr": 1 / first if first else 0.0,
                "ndcg": dcg(flags) / dcg([1] * min(len(rel), k)),
                "map": sum(precisions) / min(len(rel), k)}
            for m, x in values.items():
                sums[m, k] = sums.get((m, k), 0.0) + x / len(relevant)
    return sums


def graded_loop(run, qrels):
    hits, grades = by_query(run, qrels)
    judged = {d for gs in grades.values() for d in gs}
    searched = [q for q in grades if q in hits]
    out = {}
    add = lambda m, k, x: out.__setitem__((m, k), out.get((m, k), 0.0) + x)
    for k in KS:
        for q in searched:
            gs = grades[q]
            top = [gs.get(d, 0) for d in hits[q][:k]]
            rel = sum(g >= 1 for g in gs.values())
            ideal = dcg(sorted(gs.values(), reverse=True)[:k])
            found = sum(g >= 1 for g in top)
            first = next((i for i, g in enumerate(top, 1) if g >= 1), None)
            n = len(searched)
            add("NDCG", k, dcg(top) / ideal / n if ideal else 0.0)
            add("MAP", k, sum(sum(g >= 1 for g in top[:i]) / i for i, g in enumerate(top, 1) if g >= 1) / rel / n if rel else 0.0)
            add("Recall", k, found / rel / n if rel else 0.0)
            add("P", k, found / k / n)
            add("MRR", k, 1 / first / len(grades) if first else 0.0)
            add("R_cap", k, found / min(rel, k) / len(grades) if rel else 0.0)
        for q, docs in hits.items():
            add("Hole", k, sum(d not in judged for d in docs[:k]) / k / len(grades))
    return out


def as_dict(frame):
    return {(r["metric"], r["k"]): r["value"] for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_binary_equals_loop(spark, seed):
    run, qrels = sample(seed)
    got = as_dict(met.evaluate_binary(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), ["dot"], CUTS))
    assert got == pytest.approx(binary_loop(run, qrels), abs=1e-12)


@pytest.mark.parametrize("seed", [1, 2])
def test_graded_equals_loop(spark, seed):
    run, qrels = sample(seed)
    got = as_dict(met.evaluate_graded(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), KS, digits=None))
    assert got == pytest.approx(graded_loop(run, qrels), abs=1e-12)


def evaluate(spark, run, qrels, cuts):
    return as_dict(met.evaluate_binary(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), ["f"], cuts))


def test_query_without_hits_stays_in_the_average(spark):
    qrels = [("s", "q", "a", 1), ("s", "q", "b", 1), ("s", "p", "a", 1)]
    got = evaluate(spark, [("s", "f", "p", "a", 1.0, 1)], qrels, {"recall": [1], "accuracy": [1]})
    assert got == {("recall", 1): 0.5, ("accuracy", 1): 0.5}


def test_precision_divides_by_k(spark):
    got = evaluate(spark, [("s", "f", "q", "a", 1.0, 1)], [("s", "q", "a", 1)], {"precision": [5]})
    assert got == {("precision", 5): 0.2}


def test_ideal_is_cut_at_k(spark):
    run = [("s", "f", "q", f"d{i}", 1.0, i) for i in range(1, 11)]
    qrels = [("s", "q", f"d{i}", 1) for i in range(1, 16)]
    assert evaluate(spark, run, qrels, {"ndcg": [10]}) == {("ndcg", 10): pytest.approx(1.0)}


METRICS = "dataset STRING, score_fn STRING, metric STRING, k INT, value DOUBLE"


def test_headline_takes_largest_k_and_best_function(spark):
    rows = [("s", "a", "ndcg", 3, 0.9), ("s", "a", "ndcg", 10, 0.4), ("s", "b", "ndcg", 10, 0.5)]
    df = spark.createDataFrame(rows, METRICS)
    assert met.headline(df).first()["headline"] == 0.5
    assert met.headline(df, score_fn="a").first()["headline"] == 0.4


def test_macro_counts_collections(spark):
    df = spark.createDataFrame([(f"s{i}", "a", "NDCG", 10, i / 10) for i in range(11)], METRICS)
    assert met.macro(df, ["score_fn"], expected=11).first()["value"] == pytest.approx(50.0)
    with pytest.raises(met.WrongCollectionCount):
        met.macro(df, ["score_fn"], expected=12)


def test_readable(spark):
    df = spark.createDataFrame([("s", "a", "recall", 1, 0.12344), ("s", "a", "mrr", 1, 0.12344)], METRICS)
    assert {r["metric"]: r["text"] for r in met.readable(df).collect()} == {"recall": "12.34%", "mrr": "0.1234"}


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([("s", "a", "recall", 1, 0.03125)], METRICS)
    assert met.readable(df).first()["text"] == f"{3.125:.2f}%"


def test_result_table_adds_the_mean_of_a_group(spark):
    rows = [(f"g/{i}", "a", "NDCG", 10, i / 10) for i in range(3)] + [("nq", "a", "NDCG", 10, 0.5)]
    df = spark.createDataFrame(rows, METRICS)
    got = {r["dataset"]: r["value"] for r in report.result_table(df, "m", {"g": 3}).collect()}
    assert got == pytest.approx({"g/0": 0, "g/1": 10, "g/2": 20, "g": 10, "nq": 50})
    with pytest.raises(met.WrongCollectionCount):
        report.result_table(df, "m", {"g": 4})


def test_a_part_alone_has_no_group_mean(spark):
    df = spark.createDataFrame([("cqadupstack/gis", "a", "NDCG", 10, 0.5)], METRICS)
    assert [r["dataset"] for r in report.result_table(df, "m").collect()] == ["cqadupstack/gis"]


def test_failed_shards_count_within_their_split(spark):
    facts = spark.createDataFrame([("train", 3, 0), ("dev", 3, 1), ("train", 4, 1)], "split string, shard_id int, errors int")
    outputs = spark.createDataFrame([("train", 3), ("dev", 3), ("train", 4)], "split string, shard_id int")
    assert [tuple(r) for r in report.without_failed(outputs, facts).collect()] == [("train", 3)]
