import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from incognita.llm import decontaminate as D

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    words = WORDS.findall(lowered(text))
    hit, found = set(), set()
    for item, t in items:
        ws = WORDS.findall(lowered(t))
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j:j + m] == ws[i:i + m]:
                    hit |= set(range(j, j + m))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "ñu", "x9", "İ", "the", "Of"]
    say = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", ".", " -", "\n"]) for _ in range(k))
    items = [(i, say(rng.choice([0, 1, 2, 5, 11, 14]))) for i in range(12)] + [(3, say(4)), (None, say(12)), (50, None)]
    docs = [(i, say(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "") + " " + say(3)) for i in range(n)]
    return [*docs, (n, None), (n + 1, "")], items


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = corpus(1)
    want = sorted((i, *brute(t, items)) for i, t in docs)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert result(D.leaks(d, b)) == want
    found, c = D.find_leaks(d, b, block_bytes=1500)
    got = sorted((r.doc_id, r[c].n_words, sum(s.stop - s.begin for s in r[c].spans), len(r[c]["items"]),
                  hashlib.sha256(",".join(r[c]["items"]).encode()).hexdigest(), bool(r[c].spans)) for r in found.collect())
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40), st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5), max_size=6), st.integers(2, 30))
def test_search_in_stretches_equals_brute_force(words, strings, stretch):
    items = [(i, " ".join(s)) for i, s in enumerate(strings)]
    rows = {(str(i), min(4, len(s)), " ".join(s[k:k + min(4, len(s))]).encode()) for i, s in enumerate(strings) for k in range(len(s) - min(4, len(s)) + 1)}
    n, spans, found = D.search(" ".join(words).encode(), D._searchers(sorted(rows)), stretch)
    want = brute(" ".join(words), items, 4)
    assert (n, sum(b - a for a, b in spans), len(found)) == want[:3]


def test_awkward_rows_and_clashing_columns(spark, small_docs):
    items = spark.createDataFrame([(5, "quick brown fox jumps over the lazy dog again and again"), (6, None), (7, "!!!")], "item_id bigint, text string")
    docs = small_docs.withColumnsRenamed({"source": "leaks"})
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id is None or r.doc_id for r in kept.collect()) == sorted([1, 2, 3, 4, True, 7, 8])
    assert D.drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert D.leaks(docs.limit(0), items).count() == 0
