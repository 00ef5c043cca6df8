import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from incognita.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngram, buckets):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, percent, min_words, ngram, buckets, seed):
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(features(text, ngram, buckets)[1])
    for text in target:
        t.update(features(text, ngram, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for i, (doc_id, text) in enumerate(docs):
        words, fs = features(text, ngram, buckets)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(fs), weight, score, None, len(words), i])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = k + 1
    return rows


def corpus():
    rng = random.Random(12)
    words = ["alpha", "Beta", "gamma", "ÄRGER", "δέλτα", "x1", "Zeta", "eta"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(7, "hot text of many copies " * 5)] * 120 + [(None, "no id " * 15), (None, None), (301, None), (302, ""), (303, " .,; "), (304, "long tail " * 150_000)]
    return docs, ["alpha beta gamma " * 4, None, "", "eta"]


@pytest.mark.parametrize("ngram,buckets", [(1, 10_000), (3, 64)])
def test_equals_brute_force(spark, ngram, buckets):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as rank", "3 as k0").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resampled(df, items, 20, 10, ngram, buckets, 5).collect()
    want = brute(docs, target, 20, 10, ngram, buckets, 5)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got) == collections.Counter(
        (r[0], r[1], r[2], r[3], r[5]) for r in want)
    ranked = {r.rank: (r.doc_id, r.score) for r in got if r.rank is not None}
    assert ranked == {r[4]: (r[0], r[3]) for r in want if r[4] is not None}


def test_stretches_of_a_text_join(monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 7)
    text = "The quick brown Fox jumps over öäü 12 the lazy dog " * 3
    for ngram in (1, 2, 4):
        got = [(n, c.tolist()) for n, c in I._codes(text.encode(), ngram, 997)]
        words, want = features(text, ngram, 997)
        assert sum(n for n, _ in got) == len(words)
        assert collections.Counter(x for _, c in got for x in c) == collections.Counter(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert I.resampled(none, none).count() == 0
    assert I.resampled(some, none, 100).collect()[0].rank == 1
    assert I.resampled(some, some, 0).collect()[0].rank is None


@pytest.mark.parametrize("kind", ["spread", "ties", "one value"])
def test_cutoff_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    n = 5000
    k0 = {"spread": rng.integers(-9999, 9999, n), "ties": rng.integers(0, 3, n), "one value": np.zeros(n, int)}[kind]
    k1 = rng.integers(0, 5, n)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(k0, k1))]
    df = spark.createDataFrame(rows, "k0 bigint, k1 bigint, k2 bigint").repartition(6).checkpoint()
    for take in (1, 2, 17, 2500, 4999, 5000):
        assert I.cutoff(df, take, last=16) == sorted(rows)[take - 1]
    assert I.cutoff(df, 0) is None
    with pytest.raises(ValueError):
        I.cutoff(df, 1, last=3)


def test_a_pivot_has_a_share_of_the_keys_on_either_side():
    rng = random.Random(4)
    for _ in range(200):
        batches = [sorted((rng.randint(0, 50), 0, rng.random()) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        parts = [batches[i:i + 3] for i in range(0, len(batches), 3)]
        pivot = I.weighted_median([(I.weighted_median([(b[(len(b) - 1) // 2], len(b)) for b in p]), sum(map(len, p))) for p in parts])
        keys = [k for b in batches for k in b]
        assert sum(k <= pivot for k in keys) >= len(keys) / 8 and sum(k >= pivot for k in keys) >= len(keys) / 8
