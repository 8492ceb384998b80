"""Whitening against the eigenvectors of the whole covariance matrix."""

import numpy as np
import pytest

from pairloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def frame(spark, vectors, parts=3):
    rows = [(k if k % 11 else None, v, 1, "x", "y") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts), rows


def whole(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def brute(rows, components=4):
    ids = [r[0] for r in rows if whole(r[1])]
    x = np.floor(256 * np.array([r[1] for r in rows if whole(r[1])], np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return ids, n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(spark, vectors, close=1e-9, **kwargs):
    df, rows = frame(spark, vectors)
    got = whitening.whitened_rows(df).collect()
    ids, n, dev, white, share = brute(rows, **kwargs)
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got) == sorted(
        (str(i), int(d)) for i, d in zip(ids, dev) for _ in range(k))
    for c in range(k):
        own = sorted(r["whitened"] for r in got if r["component"] == c + 1)
        either = [np.abs(np.array(own) - np.sort(s * white[:, c])).max() for s in (1, -1)]
        assert min(either) < close
        assert [r["explained"] for r in got if r["component"] == c + 1] == pytest.approx([share[c]] * len(ids), rel=1e-9)


def test_whole_query_with_copies_and_broken_rows(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(300, 12)) * np.linspace(1, 3, 12)
    vectors = [list(map(float, v)) for v in base]
    vectors += [vectors[5]] * 150 + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [-0.0] * 12]
    compare(spark, vectors)


def test_low_rank_gives_only_its_components(spark):
    draw = np.random.default_rng(2)
    flat = draw.integers(-40, 40, size=(60, 2)) @ np.array([[1, 0, 1, 0, 2], [0, 1, 1, 0, 0]]) / 256
    compare(spark, [list(map(float, v)) for v in flat], components=2)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_no_variance_no_rows(spark, vectors):
    assert whitening.whitened_rows(frame(spark, vectors, 1)[0]).collect() == []


def test_small_blocks_and_wide_numbers(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 500)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(90, 6)) * np.array([1, 3, 40, 900, 3e4, 2])
    compare(spark, [list(map(float, v)) for v in base], close=1e-6)  # squares cost the brute force half its digits


def test_ragged_vectors_raise(spark):
    with pytest.raises(Exception, match="differ in width"):
        whitening.whitened_rows(frame(spark, [[1.0, 2.0], [1.0]], 1)[0]).collect()


def test_exact_deviation_beyond_doubles():
    x = np.array([[2**40, -(2**40)]])
    assert whitening.deviations(x, 10**6, [3, 5]) == [(10**6 * 2**40 - 3) ** 2 + (10**6 * 2**40 + 5) ** 2]


@pytest.mark.parametrize("values", [np.ones(9), np.array([5.0] * 3 + [1.0] * 6), np.geomspace(1, 1e-6, 9),
                                    np.array([3.0, 2.0] + [0.0] * 7)])
def test_repeated_and_tiny_deviations(values):
    """Equal singular values need new starts; their vectors may turn, the space may not."""
    draw = np.random.default_rng(6)
    turn = np.linalg.qr(draw.standard_normal((9, 9)))[0]
    a = draw.standard_normal((40, 9))
    a = np.linalg.qr(a)[0] * values @ turn.T
    got, right = whitening.bidiagonalise(lambda p: (float((a @ p) @ (a @ p)), a.T @ (a @ p)), 9, 4)
    assert np.allclose(got, np.sort(values)[::-1][:4], rtol=1e-9, atol=1e-12)
    assert np.allclose(right @ right.T, np.eye(4), atol=1e-10)
    assert np.allclose(np.linalg.norm(a @ right.T, axis=0), got, atol=1e-10)


def test_wide_rows_stop_early():
    draw = np.random.default_rng(7)
    a = np.linalg.qr(draw.standard_normal((300, 200)))[0] * np.geomspace(1, 1e-8, 200)
    passes = []
    got, _ = whitening.bidiagonalise(lambda p: (passes.append(1) or float((a @ p) @ (a @ p)), a.T @ (a @ p)), 200, 4)
    assert len(passes) < 100 and np.allclose(got, np.geomspace(1, 1e-8, 200)[:4], rtol=1e-12)
