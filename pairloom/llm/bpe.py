"""Byte-pair encoding of whole texts and decoding of ids, under a public tokenizer file.

A word starts as a doubly linked list of symbols. Every neighbouring pair that the file can merge enters
a priority queue under (rank of the merge, place of its left symbol). The queue gives the next merge; an
entry is stale, and skipped, if its left symbol is gone or its pair has changed since. A merge unlinks the
right symbol and queues the two new pairs, so a word of n symbols takes n log n steps however long it is.
Decoding concatenates the vocabulary's strings, a blank between two of them (the file names no decoder).

The text before the merges is treated as the file says: special tokens are cut out of the raw text, the
rest is normalised and split by the library's own normaliser and splitter. White space separates words in
such a file and is dropped, so pieces between ASCII blanks are coded on their own, each distinct piece
of a task once; a word that returns inside other pieces is merged once, too.

Work is per row, without a shuffle. A task holds a slice of texts (a longer text is a slice of its own)
and the ids of about ``CACHED_PIECES`` pieces.

Defined results: NULL text is empty, an empty text has no ids and decodes to the empty text. Rows are
independent: repeated rows, NULL doc_id and extra columns of any name change nothing. Bytes that are not
UTF-8 are read as U+FFFD. An id outside the vocabulary raises when decoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.columns import bound_batches, flat, slices
from pairloom.llm.subwords import default_path

SLICE = 1 << 21  # bytes of text coded at once
CACHED_PIECES = 400_000  # pieces, and words, whose ids a task remembers
CACHED_IDS = 4_000_000
CACHED_BYTES = 64  # a longer word is merged anew each time
GONE = -1
# A queue entry is one number: rank of the merge, then place of its left symbol; small numbers are faster.
SHORT_BITS, LONG_BITS = 14, 40
# ASCII that prints, and Latin letters that are composed as they stand and lower-case to one letter.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")


class Merges:
    """The vocabulary and the merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or odd or file["decoder"] or file["post_processor"]:
            raise ValueError(f"only plain byte-pair files without a decoder can be coded, found {odd or model['type']}")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        if [w for w, _ in self.splitter.pre_tokenize_str("a b")] != ["a", "b"]:
            raise ValueError("the file keeps white space, so texts can't be cut there")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.partners: list[dict[int, int]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.partners[self.vocab[a]][self.vocab[b]] = rank  # right symbol: rank of the merge
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("special tokens must stand for their own characters alone")
        names = "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True))
        self.special = re.compile(f"({names})") if names else None
        self.latin = self._latin_rule(file)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]  # shown as the code points from 256 on
        self.signs = {b: 256 + k for k, b in enumerate(hidden)}
        self.words: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _latin_rule(file: dict) -> re.Pattern | None:
        """The file's pattern for printable Latin text in lower case, if it has the usual parts only."""
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        steps = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        rule = steps[0]["pattern"].get("Regex", "")
        rule = rule.replace(r"\p{L}", "a-z\u00df-\u00f6\u00f8-\u017f").replace(r"\p{N}", "0-9")
        return re.compile(rule) if steps[0]["invert"] and "\\p" not in rule else None

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word of the splitter."""
        partners, made, last = self.partners, self.made, len(word) - 1
        bits = SHORT_BITS if last < 1 << SHORT_BITS else LONG_BITS
        places = (1 << bits) - 1
        ids = [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.end]]
        before, after = list(range(-1, last)), list(range(1, last + 2))
        queue, left = [], partners[ids[0]]
        for i, right in enumerate(ids[1:]):
            rank = left.get(right)
            if rank is not None:
                queue.append(rank << bits | i)
            left = partners[right]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & places
            j, left = after[i], ids[i]
            if j > last or left == GONE or partners[left].get(ids[j]) != entry >> bits:
                continue  # stale
            new = ids[i] = made[entry >> bits]
            ids[j] = GONE
            h, k = before[i], after[j]
            after[i] = k
            if k <= last:
                before[k] = i
                rank = partners[new].get(ids[k])
                if rank is not None:
                    heappush(queue, rank << bits | i)
            if h >= 0:
                rank = partners[ids[h]].get(new)
                if rank is not None:
                    heappush(queue, rank << bits | h)
        return tuple([i for i in ids if i != GONE])

    def _split(self, text: str) -> list[str]:
        """Words as the file's normaliser and splitter give them; printable Latin text needs neither."""
        if self.latin and LATIN.fullmatch(text):
            words = self.latin.findall(text.lower())
            if text.isascii():
                return words
            return [w.encode().decode("latin-1").translate(self.signs) for w in words]
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self._split(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) <= CACHED_BYTES:
                    if len(self.words) >= CACHED_PIECES:
                        self.words.clear()
                    self.words[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        if not (self.special and self.special.search(text)):
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.specials[part])
            elif part:
                out += self._plain(part)
        return out


class Encoder:
    """Ids of many texts; each distinct piece between blanks is encoded once."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.pool, self.ends = array("i"), array("q", [0])

    def _learn(self, pieces: list[bytes]) -> None:
        place, pool, ends, encode_ = self.place, self.pool, self.ends, self.merges.encode
        for piece in pieces:
            if piece not in place:
                pool.extend(encode_(piece.decode("utf-8", "replace")))
                place[piece] = len(ends) - 1
                ends.append(len(pool))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array (NULL is empty) and the offsets of each row's."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        first = np.asarray(lists.offsets)
        words = lists.values.slice(first[0], first[-1] - first[0]).cast(pa.large_binary()).dictionary_encode()
        pieces = words.dictionary.to_pylist()
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        self._learn(pieces)
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))[words.indices.to_numpy()]
        ends, pool = np.array(self.ends), np.array(self.pool, np.int32)
        size = ends[at + 1] - ends[at]
        stops = np.concatenate([[0], np.cumsum(size)])
        out = pool[np.repeat(ends[at] - stops[:-1], size) + np.arange(stops[-1])]
        if len(self.place) > CACHED_PIECES or len(pool) > CACHED_IDS:
            self._clear()
        return out, stops[first - first[0]]


class Decoder:
    """Texts of id lists: the vocabulary's strings, a blank between two."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names = {i: s for s, i in file["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in file["added_tokens"]}
        raw = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.known = np.array([i in names for i in range(len(raw))])
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows, and where each row starts; a row's last byte is the blank to leave out."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.bytes[at], ends[first]


def _strings(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    whole = raw.tobytes()
    return [whole[a:max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``ids`` of every row."""
    path = tokenizer or default_path()
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    narrow = docs.select(F.col(text).cast("string").alias("_text"), *own)

    def run(batches):
        coder = Encoder(path)
        for batch in batches:
            _, offsets = flat(batch.column(0))
            for i, j, _, _ in slices(np.zeros(0, np.uint8), offsets, SLICE):
                ids, first = coder.ids(batch.column(0).slice(i, j - i))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                rest = [batch.column(k).slice(i, j - i) for k in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*names, "ids"])

    names = [f"_{i}" for i in range(len(keep))]
    types = [f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names]
    coded = narrow.mapInArrow(run, ", ".join([*types, "ids array<int>"]))
    return coded.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "ids")


def decode(coded: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of its ids; NULL ids decode to NULL."""
    path = tokenizer or default_path()
    state: dict = {}

    def run(lists: pa.Array) -> pa.Array:
        decoder = state.get(path) or state.setdefault(path, Decoder(path))
        out: list = []
        for start in range(0, len(lists), 64):
            part = lists.slice(start, 64)
            held = part.fill_null([])
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))])
            raw, at = decoder.texts(held.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64))
            out += [s.decode() if ok else None for s, ok in zip(_strings(raw, at), part.is_valid().to_pylist())]
        return pa.array(out, pa.string())

    return coded.withColumn("decoded", F.arrow_udf(run, "string")(F.col(ids)))


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` and ``decode`` in one pass over the texts.

    Ids and decoded texts stay in the task that made them; only their digests leave it.
    """
    path = tokenizer or default_path()
    bound_batches(docs.sparkSession)

    def run(batches):
        coder, decoder = Encoder(path), Decoder(path)
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for i, j, _, _ in slices(np.zeros(0, np.uint8), offsets, SLICE):
                ids, first = coder.ids(batch.column(1).slice(i, j - i))
                little = memoryview(ids.astype("<u4")).cast("B")
                raw, at = decoder.texts(ids, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first)),
                     pa.array([hashlib.sha256(little[4 * a:4 * b]).hexdigest()
                               for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.string()),
                     pa.array([hashlib.sha256(s).hexdigest() for s in _strings(raw, at)], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
