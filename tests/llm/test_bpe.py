"""Merge-queue encoding against the tokenizers library, and decoding against its decode."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import bpe
from pairloom.llm.subwords import default_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def odd_texts():
    draw = random.Random(3)
    ranges = [(32, 127), (9, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x1FA00)]
    mixed = ["".join(chr(draw.choice([draw.randrange(*draw.choice(ranges)), 32, 39, draw.randrange(97, 123)]))
                     for _ in range(draw.randrange(1, 40))) for _ in range(500)]
    return [None, "", " \t\n", "a", "<|endoftext|>", "x<|endoftext|>Y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>",
            "ΑΣ Σ İstanbul é H̱ ẖ", "a\x85b\x1cc\x00d", "don't 'Tis 'S'T it'll", "aB" * 3000, "z" * 9000,
            "".join(map(chr, range(33, 0x250))), " ".join(map(chr, range(33, 0x250))), "ŸÀÉÎĀŁñßſŉ'Éa-Ü.",
            "😀👍🏽 ½ 一二三 ١٢٣ ́a", "word " * 5000, "word " * 5000, *mixed]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    texts = odd_texts()
    ids, first = bpe.Encoder(default_path()).ids(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == ids_of(library, text), text


def test_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    coder = bpe.Encoder(default_path())
    for text in odd_texts()[:60]:
        ids, _ = coder.ids(pa.array([text], pa.string()))
        assert ids.tolist() == ids_of(library, text)


def test_merges_follow_the_smallest_rank_anew():
    """The plain rule: merge the leftmost pair of smallest rank until no pair merges."""
    coder, draw = bpe.Merges(default_path()), random.Random(8)
    for _ in range(300):
        word = "".join(draw.choice("aeinrst") for _ in range(draw.randrange(1, 25)))
        ids = [coder.vocab[c] for c in word[:-1]] + [coder.vocab[word[-1] + "</w>"]]
        while True:
            ranked = [(coder.partners[a][b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if b in coder.partners[a]]
            if not ranked:
                break
            rank, i = min(ranked)
            ids[i:i + 2] = [coder.made[rank]]
        assert coder.merge(word) == tuple(ids)


def test_long_word_stays_fast():
    assert sum(1 for _ in bpe.Merges(default_path()).merge("ab" * 100_000)) > 1000


def test_digests_encode_and_decode_agree(spark, library):
    texts = odd_texts()[:80]
    rows = [(k if k % 9 else None, t, "n", "m") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _0 string").repartition(3)
    want = []
    for i, t, *_ in rows:
        ids = ids_of(library, t)
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.digests(docs).collect())
    coded = bpe.decode(bpe.encode(docs, keep=("doc_id", "text")))
    for r in coded.collect():
        ids = ids_of(library, r["text"])
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids, skip_special_tokens=False))


def test_empty_table_and_missing_ids(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([49407, 320],)], "ids array<int>")
    assert sorted(str(r["decoded"]) for r in bpe.decode(lists).collect()) == ["", "<|endoftext|> a</w>", "None"]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()


def test_other_files_are_refused(tmp_path):
    with open(default_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="byte_fallback"):
        bpe.Merges(str(tmp_path / "t.json"))
