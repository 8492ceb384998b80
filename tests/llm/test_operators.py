"""Every operator against a brute-force version, with NULLs, ties, repeated rows, empty and long texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pairloom.llm import (decontamination, fingerprints, language, licenses, lm, neardup, packing,
                          subwords, suffixes, toxicity, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, row string"
LOW = {i: i + 32 for i in range(65, 91)}


def texts():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghi é") for _ in range(draw.randint(2, 9))).strip() or "a" for _ in range(600)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, out = line(80), []
    for k in range(70):
        text = line(draw.choice([3, 30, 90, 150]))
        if k % 5 == 0:
            text += ". " + passage[draw.randint(0, 60):] + ". " + line(20)
        if k % 9 == 0:
            text += " This is licensed under CC BY-NC 4.0. All rights reserved, CC BY."
        out.append(text)
    base = line(140).split()
    for k in range(25):  # near copies
        copy = list(base)
        for _ in range(k % 7):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    out += [out[3]] * 4 + [None, "", " \n\t", "...", "Z", "éß", "a" * 3000, "ab" * 700, line(4000), line(4000)]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(k * 3, t) for k, t in enumerate(texts())]
    return [*found, found[7], (None, "no id here " * 40), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ["en", "fr", None][k % 3], "s", 0, "x", "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def count(pairs):
    return collections.Counter(pairs)


def repeated(raws, length):
    where = collections.Counter(r[k:k + length] for r in raws for k in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if where[r[k:k + length]] > 1:
                gone[k:k + length] = True
        yield gone


@pytest.mark.parametrize("hot", [0, 2, 10**6])
def test_repeated_strings(docs, rows, hot):
    raws = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), raw, gone in zip(rows, raws, repeated(raws, 60)):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    found = suffixes.removed(docs, length=60, gram=20, hot=hot)
    got = [tuple(r)[:5] for r in found.collect()]
    assert count(got) == count(want)


def test_loser_tree_is_a_merge():
    draw = random.Random(2)
    runs = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(n)) for n in (0, 1, 9, 40, 23)]
    found = list(suffixes.LoserTree([suffixes.front_code(r) for r in runs]))
    assert [f[2] for f in found] == sorted(x for r in runs for x in r)
    assert all(runs[f[0]][f[1]] == f[2] for f in found)
    for a, b in zip(found, found[1:]):
        n = next((k for k in range(min(len(a[2]), len(b[2]))) if a[2][k] != b[2][k]), min(len(a[2]), len(b[2])))
        assert b[3] == n


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j:j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, rows):
    want = jaccard_groups(rows)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_prefix_filter_finds_every_similar_pair(spark):
    draw = random.Random(3)
    sets, base = {}, [draw.randrange(10**9) for _ in range(60)]
    for i in range(80):
        own = set(base)
        for x in draw.sample(base, draw.randint(0, 8)):
            own.remove(x)
            if draw.random() < 0.5:
                own.add(draw.randrange(10**9))
        sets[i] = sorted(own)
    frame = spark.createDataFrame([(i, i % 40, s) for i, s in sets.items()], "cid long, part long, shingles array<long>")
    got = {tuple(r) for r in neardup.across(frame, 85).collect()}
    for a in sets:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a < b and a % 40 != b % 40 and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in got


def test_near_duplicate_stage_keeps_none_of_similarity_080_to_085(spark):
    draw = random.Random(12)
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    sets, rows, want = lambda w: {tuple(w[j:j + 5]) for j in range(len(w) - 4)}, [], set()
    for k in range(30):
        base = fresh(100)
        longer = base + fresh(14 + k % 15)  # similarity 0.774 to 0.873
        a, b = sets(base), sets(longer)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(longer))]
        want |= {2 * k} | ({2 * k + 1} if 100 * len(a & b) < 80 * len(a | b) else set())
    assert 30 < len(want) < 60
    got = neardup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)


def test_components(spark):
    from pairloom.llm.components import components

    draw = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 200) if k % 50 != 49] + [(7, 900 + draw.randrange(300)) for _ in range(300)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got[199] == 150 and got[49] == 0 and all(v == 0 for k, v in got.items() if k >= 900)


def test_token_ids_equal_those_of_whole_texts(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(subwords.default_path())
    coder = subwords.Subwords(subwords.default_path())
    odd = ["It's THE a.b c,, ''d  x y \x1f z\x1f", "naïve İstanbul ΣΑΣ éa 中文 ﬁ <|endoftext|> 12ab", "don't...!! _x_ \x7f"]
    for t in [t or "" for _, t in rows] + odd:
        data = np.frombuffer(t.encode(), np.uint8)
        ids, first = coder.ids(data, np.array([0, len(data)]))
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows):
    pieces = packing.token_pieces(docs, capacity=256).cache()
    back = collections.defaultdict(list)
    for r in pieces.collect():
        assert r["length"] == len(r["ids"]) <= 256
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        back[r["doc_id"]].append(r["piece"])
    assert all(sorted(set(v)) == list(range(max(v) + 1)) for v in back.values())
    placed = packing.pack(pieces, 256, max_documents=6, max_attention=66_000).collect()
    held = collections.defaultdict(list)
    for r in placed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        n = [n for _, n in own]
        assert sum(n) <= 256 and len(n) <= 6 and sum(x * x for x in n) <= 66_000
    assert len(placed) == pieces.count()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_close_to_the_bound(rule):
    draw = random.Random(6)
    counts = collections.Counter(min(4096, int(draw.expovariate(1 / 700)) + 1) for _ in range(30_000))
    p = packing.best_fit(counts, 4096, 4096, 4096 * 4096, (1.0, 0.001, 0.001), rule)
    used = {}
    for k in range(len(p["length"])):
        last = p["rank"][k + 1] if k + 1 < len(p["length"]) and p["length"][k + 1] == p["length"][k] else counts[p["length"][k]]
        bins = (last - p["rank"][k]) // p["each"][k]
        for b in range(bins):
            used[p["sequence"][k] + b] = used.get(p["sequence"][k] + b, 0) + p["each"][k] * p["length"][k]
    total = sum(n * c for n, c in counts.items())
    assert sum(used.values()) == total and max(used.values()) <= 4096
    assert len(used) <= 1.02 * -(-total // 4096) + 1


def test_sequences_hold_whole_ids(docs):
    pieces = packing.token_pieces(docs.filter("doc_id < 60"), capacity=128).cache()
    out = packing.sequences(packing.pack(pieces, 128)).collect()
    assert sum(len(r["ids"]) for r in out) == sum(len(r["ids"]) for r in pieces.collect())


def test_decontamination(spark):
    item = "A train leaves the old station at 12 km per hour and Maria waits for it near the second bridge over the river Sava"
    other = "The baker sells 7 loaves to Peter before noon while the mill grinds 30 kg of fresh flour for the next day"
    asked = item.replace("12", "45").replace("Maria", "Olga").replace("Sava", "Drina")
    mixed = "x 1 y 2 z 3 " * 20
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "four words in it"), (5, "four words in it")],
                                      "item_id long, text string")
    rows = [(1, f"before it. {item}. after it"), (2, f"so then {asked} and more"), (3, mixed), (4, None), (5, ""),
            (6, " ".join(item.split()[:9])), (7, "so we have four words in it today"), (8, item + " " + other), (8, item + " " + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminated(docs, benchmark).collect()
    pairs = count((r["doc_id"], r["item_id"], r["kind"]) for r in got)
    assert pairs == count([(1, 1, "exact"), (2, 1, "reparameterised"), (7, 5, "exact"), (7, 5, "exact"),
                           (8, 1, "exact"), (8, 1, "exact"), (8, 2, "exact"), (8, 2, "exact")])


def test_decontamination_by_all_windows_of_an_item(spark):
    sums = "12 + 7 = 19, 30 - 4 = 26, 15 + 15 = 30, 81 / 9 = 9, 6 * 7 = 42"
    capital = "what is the longest river that flows from Austria through Slovenia and Croatia down to Serbia and Belgrade"
    names = "Anna Boris Carl Dora Emil which of the five is Fritz Gerd Hans Ines Jana Karl Lena Mario Nora"
    mixed = "On 12 May 1999 at 10 Elm Street the old bank was robbed by 3 men with 2 guns for 900 dollars in cash"
    benchmark = spark.createDataFrame(enumerate([sums, capital, names, mixed], 1), "item_id long, text string")
    rows = [(1, f"Add up. {sums}. So it is."), (2, capital.upper()), (3, f"and {capital.lower()} again"), (4, names),
            (5, "People ask Mia which of the five is Olga or so, and nobody can tell which of the five is right"),
            (6, mixed.upper()), (7, mixed.replace("12", "17").replace("Elm", "Oak").replace("900", "450")),
            (8, "12 + 8 = 20, 31 - 4 = 27, 1 + 15 = 16, 80 / 10 = 8, 6 * 6 = 36")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["kind"]) for r in got) == [
        (1, 1, "exact"), (2, 2, "exact"), (3, 2, "exact"), (4, 3, "exact"), (6, 4, "exact"), (7, 4, "reparameterised")]


def test_decontamination_wants_consistent_slots(spark):
    item = ("from Anna to Boris then from Boris to Anna then from Anna to Boris then from Boris to Anna "
            "then from Anna to Boris then from Boris to Anna")
    good = item.replace("Anna", "Carl").replace("Boris", "Dora")
    names = iter("Ed Flo Gus Hal Ida Jon Kim Lea Max Ned Ola Pia".split())
    bad = re.sub("Anna|Boris", lambda m: next(names), item)
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert [r["doc_id"] for r in found.collect()] == [1]


def test_licenses(docs, rows):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t in rows:
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW).encode())]
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted({x for _, x in at}))))
    got = licenses.licenses_of_documents(docs).collect()
    assert count(tuple(r)[:6] for r in got) == count(want)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert any("cc-by-nc-4.0" in r["labels"] for r in got)


def test_license_templates_need_their_phrases(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "mit released license the under"),
                                  (3, "Licensed under the Apache License, Version 2.0 now")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.licenses_of_documents(docs).collect()}
    assert got == {1: "mit", 2: "", 3: "apache-2.0"}


def test_fingerprints(docs, rows):
    order = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: x[0])
    got = collections.defaultdict(list)
    for r in fingerprints.fingerprints(docs).collect():
        got[r["doc_id"]].append(r)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        stay = len(t) - len(t) // 4
        e = t[:stay] + u[:len(t) // 4]
        own = [fingerprints.fingerprint(x) for x in (t, e, u)]
        text = [x.astype(">u2").tobytes().hex() for x in own]
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), *text[:2],
                fingerprints.likeness(own[0], own[1]), fingerprints.likeness(own[0], own[2]))
        assert want in [tuple(r)[1:] for r in got[i]]
    assert sum(map(len, got.values())) == len(rows)


def test_phrases_are_a_lempel_ziv_parse():
    data, seen, phrase = b"abababcabababcaaaa" * 9, set(), b""
    for byte in data:
        phrase += bytes([byte])
        if phrase not in seen:
            seen.add(phrase)
            phrase = b""
    phrases, hashes = {}, [0]
    fingerprints.parse(data, phrases, hashes, 0)
    assert len(phrases) == len(seen) == len(set(hashes)) - 1


def test_language(spark):
    draw = random.Random(8)
    syllables = {"aa": ["tho", "ing", "ble", "ned"], "bb": ["ção", "elh", "os", "qui"], "cc": ["ung", "sch", "ßt", "ei"]}
    rows = [(k, " ".join("".join(draw.choices(s, k=3)) for _ in range(30)), lang)
            for k, (lang, s) in enumerate(list(syllables.items()) * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 ...", "cc"), (503, "thoing thoing", None), (None, "ungsch ßtei ungei", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.defaultdict(list)
    for r in language.language_of_documents(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t, lang in rows[:180]:
        assert got[i][0]["lang_pred"] == lang and got[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i][0]["lang_pred"] for i in (500, 501, 502, 503, None)] == ["und", "und", "und", "aa", "cc"]
    assert all(0 <= r["score"] <= 1 for own in got.values() for r in own)


def test_rare_language_stays_when_the_bound_binds(spark):
    draw = random.Random(9)
    syllables = ["".join(draw.choices("abdefghiklmnoprstuvw", k=3)) for _ in range(150)]
    rare = "quiosção elhosqui quielhção osqui elhção quios ção elhosqui"
    rows = [("".join(draw.choices(syllables, k=1000)), "aa") for _ in range(220)] + [(rare, "bb")]
    assert 10_000 * len(rare) <= 1.1 * sum(len(t) for t, _ in rows)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    counts = language.count_grams(docs).filter("n > 1")
    assert language.most_frequent(counts, 4000).filter("lang = 'bb'").count() == 0  # one threshold for all
    kept = language.most_frequent_each(counts, 4000).toPandas()
    assert len(kept) <= 4000 and (kept["lang"] == "aa").sum() > 1000
    assert (kept["lang"] == "bb").sum() == counts.filter("lang = 'bb'").count()
    model = language.train(docs, max_grams=4000)
    other = spark.createDataFrame([("osção quielh",), ("".join(syllables[:9]),)], "text string")
    found = [r[0] for r in other.select(language.predict(model, "text", spark)["lang_pred"]).collect()]
    assert found == ["bb", "aa"]
    few = language.most_frequent_each(spark.createDataFrame([("cc", k, 2) for k in range(900)] + [("aa", 1, 9)], "lang string, gram long, n long"), 100)
    assert 50 < few.filter("lang = 'cc'").count() < 150 and few.filter("lang = 'aa'").count() == 1


def test_code_lengths_are_those_of_method_c():
    """Against a plain recursive coder on counts that are all kept."""
    import pandas as pd

    corpus = [b"abracadabra", b"abcabc", b"the cat"]
    grams = collections.Counter()
    for raw in corpus:
        data = np.frombuffer(raw, np.uint8)
        grams.update(language.grams(data, np.array([0, len(data)])).tolist())
    model = language.freeze(pd.DataFrame([("x", g, n) for g, n in grams.items()], columns=["lang", "gram", "n"]))
    below = [collections.Counter() for _ in range(4)]
    for g, n in grams.items():
        for order in range(4):
            below[order][g & ((1 << 8 * (order + 1)) - 1)] += n

    def bits(gram, order):
        if order < 0:
            return 8.0
        g = gram & ((1 << 8 * (order + 1)) - 1)
        after = {k: n for k, n in below[order].items() if k >> 8 == g >> 8}
        if not after:
            return bits(gram, order - 1)
        total = sum(after.values()) + len(after)
        return -math.log2(after[g] / total) if g in after else -math.log2(len(after) / total) + bits(gram, order - 1)

    for raw in (b"abracat", b"zebra", b"a", b"\xc3\xa9t\xc3\xa9"):
        data = np.frombuffer(raw, np.uint8)
        at = np.array([0, len(data)])
        want = sum(bits(int(g), 3) for g in language.grams(data, at))
        assert language.Coder(model).bits(data, at)[0, 0] == pytest.approx(want, rel=1e-5)


def test_attention_is_causal_and_sums_to_one():
    ids = np.array([5, 6, 5, 7, 5, 6, lm.END])
    at = np.array([0, len(ids)])
    rows, p = np.arange(lm.VOCABULARY) % lm.ROWS, lm.start()
    before, likely = lm._before(ids, at), np.full(len(ids), 0.25)
    prob = lambda x, b=before: lm.forward(p, x, b, rows, likely, *lm.windows(at))[0][0][:len(ids)]
    whole = prob(ids)
    changed = ids.copy()
    changed[5] = 9
    assert np.allclose(prob(changed, lm._before(changed, at))[:5], whole[:5], atol=1e-6)
    gate = 1 / (1 + math.exp(1.0))
    copied = []
    for token in (5, 6, 7, 8):
        one = ids.copy()
        one[6] = token
        copied.append((prob(one)[6] - (1 - gate) * 0.25) / gate)
    assert sum(copied) == pytest.approx(1, abs=1e-5) and copied[3] == pytest.approx(0, abs=1e-6)


def test_training_lowers_the_loss():
    draw = np.random.default_rng(0)
    ids = np.concatenate([np.tile(draw.integers(10, 200, 6), 12) for _ in range(40)])
    at = np.arange(0, len(ids) + 1, 72)
    rows, p = np.arange(lm.VOCABULARY) % lm.ROWS, lm.start()
    memory = {k: np.zeros(v.shape) for k, v in p.items()}
    before, likely, loss = lm._before(ids, at), np.full(len(ids), 1e-3), []
    for _ in range(15):
        prob, live, _, held = lm.forward(p, ids, before, rows, likely, *lm.windows(at))
        loss.append(-np.log(prob[live]).mean())
        lm.backward(p, memory, prob, live, held)
    assert loss[-1] < loss[0] - 0.5


def plain_step(p, ids, at, before, rows, likely):
    """Probabilities and gradients of the mean loss, target by target."""
    prob, grads = np.zeros(len(ids)), {k: np.zeros(v.shape) for k, v in p.items()}
    for first, end in zip(at[:-1], at[1:]):
        for x in range(first, end):
            places = np.arange(max(first, first + (x - first) // lm.TARGETS * lm.TARGETS - lm.CONTEXT), x)
            a, gate = rows[before[x]], 0.0
            copied, weight = 0.0, np.zeros(len(places))
            r, same = rows[before[places]], ids[places] == ids[x]
            if len(places):
                weight = np.exp(np.minimum(p["key"][r].astype(float) @ p["ask"][a] + p["far"][x - places], 60))
                weight /= weight.sum()
                gate, copied = 1 / (1 + np.exp(-float(p["gate"][a]))), weight[same].sum()
            prob[x] = gate * copied + (1 - gate) * likely[x]
            scale = -1 / prob[x] / len(ids)
            grads["gate"][a] += scale * (copied - likely[x]) * gate * (1 - gate)
            logit = scale * gate * weight * (same - copied)
            grads["ask"][a] += logit @ p["key"][r]
            np.add.at(grads["key"], r, logit[:, None] * p["ask"][a])
            np.add.at(grads["far"], x - places, logit)
    return prob, grads


def test_step_is_that_of_a_plain_loop_and_leaves_other_rows():
    draw = np.random.default_rng(4)
    sizes = [1, 31, 32, 33, 64, 150, 7]
    at = np.cumsum([0, *sizes])
    ids = draw.integers(10, 60, at[-1])
    ids[at[1:] - 1] = lm.END
    rows, p, before = np.arange(lm.VOCABULARY) % lm.ROWS, lm.start(), lm._before(ids, at)
    likely = draw.uniform(1e-3, 0.3, len(ids))
    want, grads = plain_step(p, ids, at, before, rows, likely)
    prob, live, target, held = lm.forward(p, ids, before, rows, likely, *lm.windows(at))
    assert sorted(target[live].tolist()) == list(range(len(ids)))
    assert np.allclose(prob[live], want[target[live]], rtol=1e-5)
    new, memory = {k: v.copy() for k, v in p.items()}, {k: np.zeros(v.shape) for k, v in p.items()}
    others = np.setdiff1d(np.arange(lm.ROWS), rows[before])
    for name in ("ask", "key", "gate"):
        memory[name][others] = -1  # a step that reads these rows takes the root of a negative number
    lm.backward(new, memory, prob, live, held)
    for name, g in grads.items():
        assert np.allclose(new[name], p[name] - lm.RATE * g / np.sqrt(g * g + 1e-10), atol=1e-4), name
    p["far"][3] = 200  # beyond the limit
    want, _ = plain_step(p, ids, at, before, rows, likely)
    prob, live, target, _ = lm.forward(p, ids, before, rows, likely, *lm.windows(at))
    assert np.allclose(prob[live], want[target[live]], rtol=1e-5)


def test_plain_words_are_told_apart_at_once(monkeypatch):
    from tokenizers import Tokenizer

    from pairloom.llm import subwords

    words = ["Plain", "word,", "END.)", "abc1", "don't", "Éclair!", "Σας", "x-y", "...", "a" * 300, "Mixed\x1f", "日本", "word,"]
    seen, split = [], subwords.LatinWords.split
    monkeypatch.setattr(subwords.LatinWords, "split", staticmethod(lambda w: seen.append(w) or split(w)))
    coder, path = subwords.Subwords(subwords.default_path()), subwords.default_path()
    for text in (" ".join(words), "\t".join(reversed(words)), "more words, then Plain"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got, _ = coder.ids(raw, np.array([0, len(raw)]))
        assert got.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["abc1", "don't", "Éclair!", "Σας", "x-y", "...", "Mixed\x1f", "日本"])


def test_lm_serves_all_bigrams_and_trains_on_all_windows(spark):
    import pyarrow as pa

    draw = np.random.default_rng(6)
    lists = [[*draw.integers(5, 25, n).tolist(), lm.END] for n in (3, 40, 200, 2000)]
    ids = spark.createDataFrame([(k, k, k, k, False, x) for k, x in enumerate([*lists, lists[1]])],
                                "k0 long, k1 long, k2 long, doc_id long, held_out boolean, ids array<int>")
    ids = ids.withColumn("k0", ids.k0 % 4).withColumn("k1", ids.k1 % 4).withColumn("k2", ids.k2 % 4)
    pairs = lm.pair_counts(ids)
    few, every = lm.statistics(pairs, 60), lm.statistics(pairs)
    n = collections.Counter((a, b) for x in [*lists, lists[1]] for a, b in zip([lm.BEGIN, *x], x))
    assert len(few["pairs"]) <= 60 and len(every["pairs"]) == len(n)
    rows = lm.with_rare(ids, pairs, spark.sparkContext.broadcast(few)).select("ids", "rare_keys", "rare_n").collect()
    assert len(rows) == 5 and all(len(r["rare_keys"]) for r in rows)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                       names=["ids", "rare_keys", "rare_n"])
    (low, high, own, at), = lm._lists(batch.column(0))
    before, row = lm._before(own, at), np.repeat(np.arange(5), np.diff(at))
    got = lm.Bigrams(few).of(before, own, row, lm._rare(batch.column(1), batch.column(2), low, high))
    total, kinds = collections.Counter(), collections.Counter(a for a, _ in n)
    for (a, _), c in n.items():
        total[a] += c
    want = [(n[a, b] - lm.DISCOUNT + lm.DISCOUNT * kinds[a] * every["one"][b]) / total[a] for a, b in zip(before.tolist(), own.tolist())]
    assert np.allclose(got, want, atol=1e-6) and np.allclose(lm.Bigrams(every).of(before, own), want, atol=1e-6)
    p = lm.start()
    memory = {k: np.zeros(v.shape) for k, v in p.items()}
    assert lm.learn(p, memory, few, lm.Bigrams(few), batch) == sum(-(-len(r["ids"]) // lm.TARGETS) for r in rows)


def test_lm_scores(docs, rows):
    counts = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "\n"])
    n, v, want = sum(counts.values()), len(counts), []
    for i, t in rows:
        w = [*re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "\n"]
        held = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        want.append((i, held, len(w), sum(counts[x] > 0 for x in w), n,
                     round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = lm.score_documents(docs).collect()
    assert {(*tuple(r)[:5], round(r["base_score"], 6)) for r in got} == set(want)
    assert len(got) == len(rows) and all(r["score"] < 0 for r in got)


def test_warc_round_trip(spark):
    long_ = "<p>é line\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a.b/c?d=1", long_), (2, "http://a.b/", long_), (2, "http://a.b/", long_), (3, None, None),
            (4, "http://x.y/\r\nz w", ""), (5, "ftp", "short"), (6, "http://q", "short"), (None, "http://n", long_),
            (7, "http://a.b/7", long_ + " "), (7, "http://a.b/7", "other")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string")
    nested = warc.round_trip(pages)
    got = count((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                for r in warc.digest_rows(nested).collect())
    want, met = collections.Counter(), set()
    for i, url, html in rows:
        raw = (html or "").encode()
        again = html == long_ and (i != 2 or (i, url) in met)  # of the repeated row one capture holds the payload
        met.add((i, url))
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
    assert got == want and nested.count() == len(rows)
    assert all(r["request"] is not None and r["metadata"] is not None for r in nested.collect())


def test_toxicity(spark):
    draw = random.Random(9)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        words, bad = draw.choices(plain, k=30), draw.random() < 0.3
        if bad:
            words[draw.randrange(30)] = draw.choice(["scumbag", "scumlord", "vilest"])
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(bad), "t"))
    rows += [(900, None), (901, ""), (None, "scumbag here"), (5, rows[5][1])]
    labels += [(0, labels[0][1], "t"), (1, None, "t"), (None, 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    got = toxicity.toxicity_of_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    right = sum(("scum" in t or "vilest" in t) == bool(by[i]["predicted"]) for i, t in rows[:600])
    assert right >= 590 and by[900]["predicted"] == by[901]["predicted"] == 0 and by[None]["predicted"] == 1
    # Block-max search equals full comparison.
    full = np.zeros((len(index.ids), len(index.terms)))
    for t, (e, w) in index.postings.items():
        full[e, t] = w
    for t in range(len(index.terms)):
        at, cosine = index.nearest(np.array([t]), np.array([1]), 5)
        score = full[:, t]
        order = np.lexsort((np.arange(len(score)), -np.round(score, 12)))
        order = [k for k in order if score[k] > 0][:5]
        assert at.tolist() == order and np.allclose(cosine, score[order])


def test_empty_tables(spark, empty):
    assert suffixes.removed(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert decontamination.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert licenses.licenses_of_documents(empty).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
    assert language.language_of_documents(empty).count() == 0
    assert lm.score_documents(empty).count() == 0
    assert toxicity.toxicity_of_documents(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert warc.digest_rows(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    passage = texts()[0]
    spark.createDataFrame([(1, " ".join(passage.split()[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path)).cache()
        if name != "packing":
            assert left.columns == columns
    assert left.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and left.count()
