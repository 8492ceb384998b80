import random

import pytest

from pairloom.operators import postprocess as post

PAIRS = "pos BIGINT, query STRING, document STRING"
CORPUS = "pos BIGINT, _id STRING, title STRING, text STRING"


def frames(spark, pairs, corpus):
    return (spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(corpus, CORPUS))


def statuses(spark, rows, texts=("T",), exclude=("Known Answer",), hot_rows=1000):
    pairs = [(i, q, d) for i, (q, d) in enumerate(rows)]
    corpus = [(i, str(i), f"t{i}", t) for i, t in enumerate(texts)]
    p, c = frames(spark, pairs, corpus)
    out = post.post_status(p, c, "document", list(exclude), hot_rows=hot_rows)
    return [r["status"] for r in out.orderBy("pos").collect()]


@pytest.mark.parametrize("rows, expected", [
    ([("", "T"), ("q", "T")], ["empty", "valid"]),
    ([("q", "T"), ("", "T")], ["valid", "repeated"]),
    ([(" ", "T")], ["valid"]),
    ([(" KNOWN answer ", "T"), ("q", "T"), ("q", "T")], ["leaked", "valid", "repeated"]),
    ([("q", "other"), ("", "other")], ["unlinked", "empty"]),
])
def test_order_of_filters(spark, rows, expected):
    assert statuses(spark, rows) == expected


def loop(rows, texts, exclude):
    """The chain with running state, row by row."""
    seen, out = set(), []
    for query, document in rows:
        if document in seen:
            out.append("repeated")
        elif query == "":
            out.append("empty")
        elif query.lower().strip() in exclude:
            out.append("leaked")
        elif document not in texts:
            out.append("unlinked")
        else:
            seen.add(document)
            out.append("valid")
    return out


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_status_equals_loop(spark, hot_rows):
    """Half of the rows share one document; with ``hot_rows=3`` several documents are salted."""
    rnd = random.Random(5)
    texts = [f"text {i}" for i in range(12)]
    rows = [(rnd.choice(["", " ", "a", "b", "Known Answer"]),
             rnd.choice(texts + ["gone 1", "gone 2"]) if rnd.random() < 0.5 else "text 0")
            for _ in range(400)]
    assert statuses(spark, rows, texts, hot_rows=hot_rows) == loop(rows, texts, {"known answer"})


def test_valid_pairs_equal_status(spark):
    rnd = random.Random(6)
    pairs = [(i, rnd.choice(["", "x", "y"]), f"d{rnd.randrange(30)}") for i in range(300)]
    corpus = [(i, str(i), "t", f"d{i % 20}") for i in range(40)]
    p, c = frames(spark, pairs, corpus)
    valid = {(r["pos"], r["corpus_id"]) for r in post.valid_pairs(p, c, "document").collect()}
    status = post.post_status(p, c, "document").filter("status = 'valid'").collect()
    assert valid == {(r["pos"], r["corpus_id"]) for r in status}


def test_last_corpus_row_wins_and_length_counts_texts(spark):
    p, c = frames(spark, [(0, "q", "T")], [(0, "1", "a", "T"), (1, "2", "b", "T")])
    status = post.post_status(p, c, "document")
    assert status.first()["corpus_id"] == "2"
    row = post.agg_loss(status, c).first()
    assert (row["corpus_length"], row["with_post"], row["lost_pct"]) == (1, 1, 0.0)


def test_empty_corpus_has_no_share(spark):
    p, c = frames(spark, [(0, "q", "T")], [])
    assert post.agg_loss(post.post_status(p, c, "document"), c).first()["lost_pct"] is None


def test_exports(spark):
    p, c = frames(spark, [(0, " ", "T"), (1, "q", "U"), (2, " w ", "U")],
                  [(0, "7", "a", "T"), (1, "8", "b", "U")])
    numbered = post.query_ids(post.valid_pairs(p, c, "document"), offset=5)
    assert sorted(map(tuple, post.export_queries(numbered).collect())) == [("5", ""), ("6", "q")]
    assert sorted(map(tuple, post.export_qrels(numbered).collect())) == [("5", "7", 1), ("6", "8", 1)]
    record = post.export_pairs(post.valid_pairs(p, c, "document"), "set", "LLM", "a/b")
    row = record.orderBy("pos").first()
    assert row["dataset"] == "set_unsupervised_LLM_a_b" and row["answers"] == ""
    assert row["positive_ctxs"][0].asDict() == {
        "title": "a", "text": "T", "score": 0, "title_score": 0, "passage_id": "7"}
    assert row["negative_ctxs"] == [] and row["hard_negative_ctxs"] == []


def test_null_keys_are_spread(spark):
    from pairloom.operators.joins import join_unique

    left = spark.range(3000).selectExpr("id AS pos", "IF(id % 3 = 0, 'a', NULL) AS k")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    joined = join_unique(left, right, ["k"], "pos", hot_rows=100)
    assert joined.count() == 3000 and joined.filter("v = 1").count() == 1000
