import collections
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from incognita.llm import lang_id as L


def words_of(text):
    return [w for w in re.findall(r"[^\W\d_]+", text.lower())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB éß1 -漢"), max_size=20), min_size=1, max_size=4))
def test_words_and_hashes(texts):
    w = L.Words(texts)
    want = [(i, x) for i, t in enumerate(texts) for x in words_of(t)]
    assert w.text.tolist() == [i for i, _ in want]
    by_word = collections.defaultdict(set)
    for (_, x), h in zip(want, w.hashes(w.begin, w.stop).tolist(), strict=True):
        by_word[x].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    at, _ = w.grams(np.arange(len(want)), 3)
    assert np.bincount(at, minlength=len(want)).tolist() == [max(0, len(x)) for _, x in want]


def grams_of(w, n):
    padded = w if n == 1 else f" {w} "
    return [padded[i:i + n] for i in range(len(padded) + 1 - n)]


def brute(train, text, keep, penalty=L.PENALTY):
    """The method over plain dictionaries."""
    langs = sorted({lang for lang, _ in train})
    counts = collections.defaultdict(collections.Counter)
    for lang, t in train:
        for w in words_of(t):
            counts[lang, 0][w] += 1
            for n in L.ORDERS:
                counts[lang, n].update(grams_of(w, n))
    assert all(len(c) <= keep for c in counts.values())
    log = lambda lang, n, x: math.log10(counts[lang, n][x] / counts[lang, n].total()) if counts[lang, n][x] else penalty
    total, words = [0.0] * len(langs), words_of(text)
    for w in words:
        for n in (0, *L.ORDERS):
            grams = [w] if n == 0 else grams_of(w, n)
            grams = [g for g in grams if any(counts[x, n][g] for x in langs)]
            if grams:
                for j, x in enumerate(langs):
                    total[j] += sum(log(x, n, g) for g in grams) / len(grams)
                break
        else:
            total = [t + penalty for t in total]
    mean = [t / max(1, len(words)) for t in total]
    share = [10 ** (m - max(mean)) for m in mean]
    return ("und", 0.0) if not words else (langs[share.index(max(share))], max(share) / sum(share))


TRAIN = [("en", "the cat and the dog are in the house"), ("en", "where is the night train to the city"), ("de", "der hund und die katze sind im haus"),
         ("de", "wo ist der nachtzug in die stadt"), ("fr", "le chat et le chien sont dans la maison"), ("fr", "où est le train de nuit pour la ville")]
ASK = ["the dog", "der Hund", "le chien Ünd", "houses and cities", "Häuser", "maisonnette", "漢字", "x", None, "", "12 !", "the der le", "nightly"]


def test_equals_plain_dictionaries(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(TRAIN)]
    model = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    langs, score, _, known = model.predict([None if t is None else t.encode() for t in ASK])
    for t, lang, s in zip(ASK, langs, score, strict=True):
        want = brute(TRAIN, t or "", L.KEEP)
        assert lang == want[0] and s == pytest.approx(want[1]), t
    assert known[ASK.index("漢字")] == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    got = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_awkward_rows(spark, small_docs):
    docs = small_docs.withColumnsRenamed({"source": "language"})
    got = {(r.doc_id, r.lang_pred) for r in L.languages(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (0, "en")} <= got
    kept = L.drop_unknown(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "0", "4", "8", "None"]
    assert L.languages(docs.limit(0)).count() == 0 == L.drop_unknown(docs.limit(0)).count()
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {(r.lang_pred, r.score) for r in L.languages(nothing).collect()} == {("und", 0.0)}


def test_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 7)
    model = L.Model(["de", "en"], {0: (np.sort(L.Words(["the"]).hashes(np.array([1]), np.array([4]))), np.array([[-7.0, -1.0]]))})
    langs, _, n, known = model.predict([b"the the the the the the", b"the"])
    assert langs == ["en", "en"] and n.tolist() == [6, 1] == known.tolist()
