import collections
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from incognita.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True

odd = st.lists(st.sampled_from([*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​   　ab1é²ß'.!-_漢\U0001f600́",
                                "'s", "'ll", " the", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(odd, st.text(max_size=30))
def test_ids_equal_the_tokenizers(text, more):
    for t in (text, more.encode("utf-8", "replace").decode(), text + more.encode("utf-8", "replace").decode()):
        assert np.frombuffer(P.encode(t, PATH), "<u4").tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_ids_of_real_texts_equal_the_tokenizers(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["a" * 200_000, "\n" * 100_000]
    assert [np.frombuffer(P.encode(t, PATH), "<u4").tolist() for t in texts] == [e.ids for e in PLAIN.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300), st.integers(1, 12), st.integers(10_000, 30_000))
def test_every_capacity_holds(rule, lengths, max_docs, max_attention):
    place = P.best_fit(np.array(lengths, np.int64), (100, max_docs, max_attention), rule=rule)
    bins = collections.defaultdict(list)
    for b, n in zip(place.tolist(), lengths, strict=True):
        bins[b].append(n)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        assert sum(b) <= 100 and len(b) <= max_docs and sum(n * n for n in b) <= max_attention
    # no two sequences could be one
    rest = sorted(bins.values(), key=sum)[:2]
    if rule == "norm" and len(rest) == 2:
        both = rest[0] + rest[1]
        assert sum(both) > 100 or len(both) > max_docs or sum(n * n for n in both) > max_attention or len(bins) == 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_near_the_lower_bound(rule):
    rng = np.random.default_rng(5)
    lengths = np.minimum(2047, rng.lognormal(6, 1, 6000).astype(int) + 1)
    used = P.best_fit(lengths, (2048, 2048, 2048.0**2), rule=rule).max() + 1
    assert used <= 1.005 * -(-lengths.sum() // 2048) + 1


def check(rows, docs, capacity):
    texts = collections.defaultdict(list)
    for d, t in docs:
        texts[d].append([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        want = collections.Counter()
        for ids in texts[d]:
            for i, (s, n) in enumerate(P.cut(len(ids), capacity)):
                want[i, s, n, P.crc32(ids[s:s + n])] += 1
        assert want == collections.Counter((r.piece, r.start, r.length, r.ids_crc32) for r in own)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_cut():
    assert P.cut(1, 8) == [(0, 1)] and P.cut(8, 8) == [(0, 8)] and P.cut(16, 8) == [(0, 8), (8, 8)] and P.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_pieces_and_places(spark, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = P.packed(small_docs.withColumnsRenamed({"source": "length", "lang": "ids"}), capacity=64).collect()
    check(got, docs, 64)
    assert P.packed(small_docs.limit(0)).count() == 0


def test_groups_pack_apart_and_stay_gapless(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "of", "words", "Straße", "x"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows = P.pieces(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), PATH, 32)
    got = P.place(rows.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) ids_crc32"), 32, group_rows=50)
    check(got.collect(), docs, 32)
    few = P.place(rows.drop("ids"), 32, max_docs=1)
    assert few.groupBy("sequence_id").count().where("count > 1").count() == 0


#: The contract's tokenizer: the flags of the file.
DEFAULT = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(odd, odd)
def test_special_ids_equal_those_of_the_default_tokenizer(text, more):
    for t in (text, text + "<|endoftext|>" + more, "<|endoftext|>" * 2 + more + "<|endoftext"):
        assert np.frombuffer(P.encode(t, PATH, special=True), "<u4").tolist() == DEFAULT.encode(t, add_special_tokens=False).ids


def test_pieces_of_texts_with_special_tokens(spark):
    texts = ["a<|endoftext|>b", " x <|endoftext|>  \n y" * 50, "plain words", "<|endoftext|>"]
    got = P.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), PATH, 16).collect()
    for i, t in enumerate(texts):
        ids = b"".join(r.ids for r in sorted(got, key=lambda r: r.piece) if r.doc_id == i)
        assert np.frombuffer(ids, "<u4").tolist() == [*DEFAULT.encode(t, add_special_tokens=False).ids, 0]
    assert [r.ids for r in got if r.doc_id == 0] == [np.array([64, 50256, 65, 0], "<u4").tobytes()]
