import collections
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from incognita.llm import simhash as S
from incognita.llm.components import components


def brute_fp(text, n=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é\t\n\x0b\xa0ñ1"), max_size=60), st.integers(1, 40))
def test_fingerprint(text, stretch):
    assert S.fingerprint(text.encode(), 4, stretch) == brute_fp(text) == S.fingerprint(text.encode())


def union(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        a, b = (next(x for x in _walk(up, y)) for y in (a, b))
        up[max(a, b)] = min(a, b)
    return [next(x for x in _walk(up, i)) for i in range(n)]


def _walk(up, i):
    while up[i] != i:
        i = up[i]
    yield i


@pytest.mark.parametrize("wide", [False, True])
def test_anchors_cover_every_pair_within_the_threshold(wide):
    rng = np.random.default_rng(2)
    anchors = S.Anchors(4, wide)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    homes = anchors.homes(x)
    at, keys = anchors.replicas(y)
    reached = collections.defaultdict(set)
    for i, k in zip(at.tolist(), keys.tolist(), strict=True):
        reached[i].add(k)
    assert all(set(homes[i].tolist()) & reached[i] for i in range(len(x)))
    assert len(at) / len(y) < (320 if wide else 25)


@pytest.mark.parametrize(("wide", "block"), [(False, 1024), (True, 1024), (False, 7)])
def test_links_give_brute_force_components(spark, wide, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = set(seeds.tolist()) | {0, 1}
    for s in [*seeds.tolist()[:10], *seeds.tolist()[:1] * 30]:
        x = s
        for _ in range(6):
            for b in rng.choice(64, 4, replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps, key=lambda v: v - (1 << 64) if v >> 63 else v)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {r.node: r.root for r in components(S.links(nodes, wide=wide, block=block)).collect()}
    assert [got.get(v, v) for v in signed] == [signed[i] for i in want]


def test_components_of_random_graphs_and_paths(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 520)] + [(600, i) for i in range(601, 700)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = union(700, pairs)
    assert all(got.get(i, i) == want[i] for i in range(700))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def corpus():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha Beta gamma delta été iota kappa mu".split()) + str(rng.randrange(60)) for _ in range(n))
    docs = []
    for i in range(30):
        t = say(120)
        docs.append((10 * i, t))
        if i % 3 == 0:
            docs.append((10 * i + 1, t))
            docs.append((10 * i + 2, t.replace(t.split()[7], "changed")))
    return [*docs, (900, None), (901, ""), (902, " \n"), (0, docs[0][1]), (None, docs[0][1]), (None, "only null ids here now"), (None, "only null ids here now"), (903, "two words")]


def test_classes_and_kept_documents(spark):
    docs = corpus()
    fps = [brute_fp(t) for _, t in docs]
    want = union(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    ids = collections.defaultdict(list)
    for i, root in enumerate(want):
        ids[root].append(docs[i][0])
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, fp string, key int")
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=key)
    assert got == sorted(((d, f"{f:016x}", least[w]) for (d, _), f, w in zip(docs, fps, want, strict=True)), key=key)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect()), key=str) == sorted(((v is None, v) for v in least.values()), key=str)
    assert S.keep_one(df.limit(0)).count() == 0 == S.near_duplicates(df.limit(0)).count()
