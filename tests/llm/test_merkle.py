"""The manifest against a plain tree that holds all nodes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, block string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k:k + 2]) for k in range(0, len(last), 2)])
    return levels


def climb(levels, k):
    for level in levels[:-1]:
        yield k & 1, level[k ^ 1] if k ^ 1 < len(level) else None
        k >>= 1


def expected(rows):
    groups = {}
    for i, text, lang, source, n, *_ in rows:
        groups.setdefault(lang, []).append((i, leaf(i, source, lang, n, text), source, n, text))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = tree([r[1] for r in groups[name]])
    crown = tree([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for k, (i, own, source, n, text) in enumerate(groups[name]):
            steps = [*climb(trees[name], k), *climb(crown, g)]
            odd = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            at = leaf(i, source, name, n + 1, text) if odd else own
            for right, sibling in steps:
                at = h(*([sibling, at] if right else [at, sibling or ""]))
            root = crown[-1][0]
            out.append((i, own, trees[name][-1][0], root, h(*[s or "" for _, s in steps]), at, at == root))
    return sorted(map(repr, out))


def rows_of(n, langs, seed=1):
    draw = random.Random(seed)
    out = [(k, draw.choice([None, "", "é text", "t" * 5000]), draw.choice(langs), draw.choice(["s", None]),
            draw.choice([None, 7, 2**63 - 1]), "x", "y") for k in range(n)]
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(repr(tuple(r)) for r in merkle.audit(docs).collect()) == expected(rows)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_every_row_of_the_manifest(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    rows = rows_of(90, ["de", "en", "en", "en", None, "", "é"])
    rows += [(5, "again", "en", "s", 1, "x", "y"), rows[7], rows[7], (None, "no id", "en", None, None, "x", "y")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [
    [(1, "t", "en", "s", 3, "x", "y")], rows_of(5, ["one"]), [(k, "t", str(k), "s", 1, "x", "y") for k in range(5)]])
def test_small_trees(spark, rows):
    check(spark, rows)


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_shows_and_another_order_of_rows_does_not(spark):
    rows = rows_of(40, ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    roots = {r["root"] for n in (1, 5) for r in merkle.manifest(docs.repartition(n)).select("root").collect()}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, "!").otherwise(F.col("text")))
    assert len(roots) == 1 and merkle.manifest(changed).first()["root"] not in roots


def test_queue_sweeps_deliver_to_every_node():
    for n in range(1, 40):
        own = [h(str(k)).encode() for k in range(n)]
        levels = merkle.levels_of(n)
        nodes = merkle.sweep_up(own, levels)
        want = tree([d.decode() for d in own])
        assert [d.decode() for d in nodes] == [d for level in want for d in level]
        for k, proof in enumerate(merkle.sweep_down(nodes, n, levels, None)):
            steps = []
            while proof:
                side, sibling, proof = proof
                steps.append((int(side == merkle.LEFT), sibling.decode() or None))
            assert steps == list(climb(want, k))
