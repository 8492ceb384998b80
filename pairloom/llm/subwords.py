"""Subword ids of whole texts by a public tokenizer file, one encoding per distinct piece of text.

Pieces between ASCII blanks are encoded on their own. That gives the ids of the whole text for a
tokenizer that drops white space and never joins across it, as ``word_bpe_49k.json`` does.

The bulk of pieces is a Latin word, with or without a few marks at its end. These are merged by tiktoken
under the merges of the same file, where a mark byte plays the end of a word, which takes a sixth of the
time; ``tokenizers`` encodes all others. Both give the same ids.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np

from pairloom.llm.columns import NO_BLANKS, SpanHash

CACHED_WORDS = 250_000  # pieces whose ids a task remembers


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MARK = "\x1f"  # one byte, never part of a Latin word
TAIL = string.punctuation.replace("'", "")  # an apostrophe may open a piece of its own


# Of every piece: the letters and the marks after them, both empty where it is anything else.
PLAIN = re.compile(f"([A-Za-z]++)([{re.escape(TAIL)}]*+)(?![^ ])|[^ ]+")


class LatinWords:
    """Ids of lower-cased Latin words (and marks after them) under a file's merges with word ends."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # Bytes stand for themselves where they print, else for the next free code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        byte = {c: b for b, c in sign.items()}
        mark = MARK.encode()
        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocab[sign[b]] for b in range(256)]
        ranks |= {bytes([b]) + mark: 256 + b for b in range(256)}
        ids += [vocab[sign[b] + "</w>"] for b in range(256)]
        for pair in model["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            end = token.endswith("</w>")
            raw = bytes(byte[c] for c in token.removesuffix("</w>")) + mark * end
            ranks[raw] = len(ids)
            ids.append(vocab[token])
        self.ids = np.array(ids, np.uint32)
        self.last = np.zeros(len(ids), bool)
        for raw, rank in ranks.items():
            self.last[rank] = len(raw) > 1 and raw.endswith(mark)
        self.coder = tiktoken.Encoding("latin", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def split(word: str) -> tuple[str, str] | None:
        """The word and the marks after it, or None where this class doesn't know."""
        core = word.rstrip(TAIL)
        if not core.isalpha() or (not core.isascii() and (max(core) >= "\u0250" or "\u0130" in core)):
            return None
        return core, word[len(core):]

    def encode(self, words: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each word's."""
        pieces = [f"{core}{MARK} {tail}{MARK}" if tail else f"{core}{MARK}" for core, tail in words]
        ranks = np.array(self.coder.encode_ordinary(" ".join(pieces).lower()), np.int64)
        ends = np.flatnonzero(self.last[ranks])
        number = np.cumsum([2 if tail else 1 for _, tail in words])
        if len(ends) != number[-1]:
            raise ValueError("words and word ends differ")
        cuts = ends[number - 1] + 1
        return self.ids[ranks], np.diff(cuts, prepend=0)


def _joined(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> str:
    """The text of these spans with a blank between them."""
    size = ends - begins + 1
    stop = np.cumsum(size)
    at = np.repeat(begins - (stop - size), size) + np.arange(stop[-1])
    part = data.take(at, mode="clip")
    part[stop - 1] = 0x20
    return part[:-1].tobytes().decode("utf-8", "replace")


class Subwords:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin = LatinWords(path)
        self.hasher = SpanHash()
        self._clear()

    def _clear(self) -> None:
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, their pieces
        self.starts, self.pool, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, joined: str) -> np.ndarray:
        """Remembers the ids of pieces joined by blanks; the place of each."""
        words = joined.split(" ")
        latin = [x if x[0] else self.latin.split(w) for w, x in zip(words, PLAIN.findall(joined))]
        other = [w for w, x in zip(words, latin) if not x]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        known = [x for x in latin if x]
        ids, sizes = self.latin.encode(known) if known else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        flat = np.concatenate([ids, np.array([i for own in found for i in own], np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(own) for own in found], np.int64)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        is_latin = np.fromiter(map(bool, latin), bool, len(latin))
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(is_latin), np.flatnonzero(~is_latin)])] = (
            len(self.starts) - 1 + np.arange(len(words)))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)])
        self.used += len(flat)
        return place

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and the offsets of each row's."""
        hashes, begins, ends, first = self.hasher.words(data, offsets, NO_BLANKS)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kinds, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.names) > CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.names, kinds)
        new = np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] != kinds) if len(self.names) else (
            np.arange(len(kinds)))
        if len(new):
            parts = np.split(sample[new], range(20_000, len(new), 20_000))
            place = [self._learn(_joined(data, begins[part], ends[part])) for part in parts]
            self.names = np.insert(self.names, at[new], kinds[new])
            self.place = np.insert(self.place, at[new], np.concatenate(place))
        at = self.place[np.searchsorted(self.names, kinds)][kind]
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        before = np.concatenate([[0], np.cumsum(size)])
        return (self.pool[np.repeat(begin - before[:-1], size) + np.arange(before[-1])], before[first])
