"""Search over all words against full comparison, votes, calibration, and held-out recall."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pytest

from pairloom.llm import toxicity


def world(seed, examples=300, words=500):
    draw = np.random.default_rng(seed)
    share = 1 / np.arange(1, words + 1)
    rows = []
    for i in range(examples):
        t, c = np.unique(draw.choice(words, draw.integers(0, 80), p=share / share.sum()), return_counts=True)
        rows.append((i * 3, int(draw.random() < (0.6 if seed and 20 in t else 0.1)), t, c))
    rows[7] = (rows[7][0], 1, rows[5][2], rows[5][3])  # a tie
    return rows, draw.random(words) * draw.choice([0.1, 3], words) + 0.01


@pytest.mark.parametrize("seed", range(3))
def test_nearest_and_votes_equal_full_comparison(seed):
    rows, worth = world(seed)
    index = toxicity.Index.build(np.arange(len(worth), dtype=np.uint64), worth, rows, block=8)
    index.calibrate(rows)
    index = toxicity.Index(pickle.loads(pickle.dumps(index.state)))
    full = [r for r in rows if len(r[2])]
    dense = np.zeros((len(full), len(worth)))
    for k, (_, _, t, c) in enumerate(full):
        dense[k, t] = (1 + np.log(c)) * worth[t]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for k, (_, _, t, c) in enumerate(full):
        for without in (-1, k):
            cosine = dense @ dense[k]
            order = [p for p in np.lexsort((np.arange(len(full)), -np.round(cosine, 12)))
                     if p != without and cosine[p] > 0][:16]
            vote, at, near = index.vote(t, c, without=without)
            assert at.tolist() == order and np.allclose(near, cosine[order])
            w = 1 / (1 - np.minimum(cosine[order], 1) + 0.05)
            assert np.isclose(vote, sum(w * [full[p][1] for p in order]) / w.sum())
    # Calibration: a stationary point of the log likelihood, Platt's targets.
    votes, y, k = [], np.array([r[1] for r in rows]), -1
    for _, _, t, c in rows:
        k += len(t) > 0
        votes.append(index.vote(t, c, without=k)[0] if len(t) else index.bare)
    votes, hot = np.array(votes), y.sum()
    target = np.where(y > 0, (hot + 1) / (hot + 2), 1 / (len(y) - hot + 2))
    a, b = index.slope
    p = 1 / (1 + np.exp(-(a * votes + b)))
    assert abs((p - target).sum()) < 1e-3 and (a == 0 or abs(((p - target) * votes).sum() + 1e-3 * a) < 1e-3)


def test_association_is_that_of_the_four_fields():
    toxic = np.array([1.0, 1, 0, 0, 0])
    got = toxicity.association(toxic, np.array([0, 1, 2]), np.array([0, 0, 1]), 2)
    cells = np.array([[2.0, 0], [0, 3]])
    want = 2 * sum(o * np.log(o * 5 / (r * c)) for o, r, c in ((cells[0, 0], 2, 2), (cells[1, 1], 3, 3)))
    assert np.isclose(got[0], want) and got[1] > 0


def test_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k % 40, f"text number {k} " + "x" * 100) for k in range(200)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels).ids) == 200  # repeated rows are one example
    assert len(toxicity.train(docs, labels, limit=50).ids) == 50
    assert len(toxicity.train(docs, labels, most_bytes=1200).ids) == 10


def test_held_out_recall(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{name}.parquet") for name in ("documents", "labels"))
    got = toxicity.toxicity_of_documents(docs, labels).toPandas().set_index("doc_id")
    truth = labels.groupBy("doc_id").agg({"toxic": "max"}).toPandas().set_index("doc_id").iloc[:, 0].dropna()
    held = [i for i in truth.index if zlib.crc32(str(i).encode()) % 5 == 0 and i in got.index]
    toxic = [i for i in held if truth[i] == 1]
    found = sum(got.loc[i, "predicted"] for i in toxic)
    false = sum(got.loc[i, "predicted"] for i in held if truth[i] == 0)
    assert found >= 0.6 * len(toxic) and false <= 0.05 * len(held)  # few examples at this size
