"""Target-distribution importance resampling: hashed n-gram weights, noisy scores, exact draw by weighted median of medians.

A text's features are its runs of 1 to ``ngram`` consecutive words (lower-cased
A-Z), each hashed to one of ``buckets`` by its CRC-32. With S features of all
documents and T of all target texts, a bucket's gain is the floored 1000-fold
log ratio of the two smoothed shares; a document's weight is the floored mean of
its features' gains, looked up in one array. Seeded Gumbel noise makes the
highest scores a draw without replacement in proportion to the weights.

The cutoff of the draw is found exactly by weighted median of medians over the
stored narrow rows. In each round every partition counts its keys above and
below the pivot and reports a median of either side (the weighted median of its
Arrow batches' medians, so no task holds more than a batch); the driver weighs
the partitions' medians by their remaining sizes and takes the next pivot from
the side that holds the cutoff. A pivot has at least an eighth of the remaining
keys on either side, so each round discards that much for certain; once a
quarter is left only that is stored and read again. The last ``LAST`` keys are
sorted. The winners are sorted by range partitions and numbered.

Scale: the texts are read twice (bucket counts; weights), the shuffle carries at
most ``buckets`` counts a task, and rows of five numbers a document are stored
in ``spark.checkpoint.dir``. The driver sees ``buckets`` counts and one row a
partition and round. Neither a hot source nor a hot text moves to one task.

Defined cases: a null text has no words, no features and weight 0; a null doc_id
hashes as the empty string and comes last among ties; repeated rows are rows of
their own, told apart by their stored place, so exactly the asked number is
drawn; texts of any length are read in stretches that overlap by the longest
feature less a word; empty tables give no rows, an empty target makes the gains
those of T = 0; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions.ranking import consecutive_index
from incognita.llm.common import col, raw, stored, word_runs

#: Keys that the driver sorts at the end of a selection.
LAST = 4096
#: A text is split into words in stretches of about so many bytes.
STRETCH = 1 << 20

#: Lower-case ASCII letters, digits and all bytes of non-ASCII characters are word bytes; the rest separates.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))

Key = tuple[int, int, int]  # ascending: minus score, doc_id (null: largest), stored place


def _codes(text: bytes | None, ngram: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in it) for each stretch of a text."""
    before: list[bytes] = []
    for words in word_runs(text or b"", _WORD, STRETCH):
        found = [np.fromiter(map(crc32, words), np.uint32, len(words))]
        if ngram > 1:
            row = before + words
            for n in range(2, ngram + 1):
                first = max(len(before), n - 1)  # features whose last word is of this stretch
                found.append(np.fromiter((crc32(b" ".join(row[i - n + 1:i + 1])) for i in range(first, len(row))), np.uint32))
            before = row[-(ngram - 1):]
        yield len(words), np.concatenate(found) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text: str, ngram: int, buckets: int) -> np.ndarray:
    """Features by bucket over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for _, codes in _codes(value, ngram, buckets):
                    total += np.bincount(codes, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(raw(text).alias("t")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # no more than ``buckets``
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000-fold log ratio of each bucket's smoothed shares."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, ngram: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, value in enumerate(batch.column(1).to_pylist()):
                for n, codes in _codes(value, ngram, buckets):
                    words[i] += n
                    features[i] += len(codes)
                    total[i] += gain[codes].sum()
            mean = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (words, features, mean))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), raw(text).alias("t")).mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int, doc_id: Column) -> Column:
    """Floored 1000-fold Gumbel noise from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def importance(docs: DataFrame, target: DataFrame, ngram: int = 1, buckets: int = 10_000, seed: int = 2024,
               id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, not yet drawn."""
    gain = gains(bucket_counts(docs, text, ngram, buckets), bucket_counts(target, target_text, ngram, buckets))
    return weights(docs, gain, ngram, id_col, text).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))


# ---- selection ---------------------------------------------------------------

def _sorted(keys: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(keys[::-1])
    return [k[order] for k in keys]


def _below(keys: list[np.ndarray], pivot: Key) -> np.ndarray:
    """Keys that come before the pivot."""
    out, same = np.zeros(len(keys[0]), bool), np.ones(len(keys[0]), bool)
    for k, p in zip(keys, pivot, strict=True):
        out |= same & (k < p)
        same &= k == p
    return out


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key up to which at least half of the weight lies."""
    half, seen = sum(w for _, w in medians) / 2, 0
    for key, w in sorted(medians):
        seen += w
        if seen >= half:
            return key
    raise ValueError("no keys")


_ROUND = "side int, n bigint, m0 bigint, m1 bigint, m2 bigint"


def _round(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> dict[int, list[tuple[Key, int]]]:
    """Medians and sizes of every partition's keys in (low, high): side 0 before the pivot, 1 from it on (all, without a pivot)."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[Key, int]]] = {0: [], 1: []}
        for batch in batches:
            ks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            keep = np.ones(batch.num_rows, bool)
            if low is not None:
                keep &= ~_below(ks, low)
            if high is not None:
                keep &= _below(ks, high)
            ks = _sorted([k[keep] for k in ks])
            cut = int(_below(ks, pivot).sum()) if pivot is not None else 0
            for side, (a, b) in enumerate(((0, cut), (cut, len(ks[0])))):
                if b > a:
                    mid = a + (b - a - 1) // 2
                    found[side].append((tuple(int(k[mid]) for k in ks), b - a))
        rows = [(side, sum(w for _, w in parts), *weighted_median(parts)) for side, parts in found.items() if parts]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["side", "n", "m0", "m1", "m2"])

    out: dict[int, list[tuple[Key, int]]] = {0: [], 1: []}
    for r in keys.mapInArrow(report, _ROUND).collect():  # two rows a partition at most
        out[r.side].append(((r.m0, r.m1, r.m2), r.n))
    return out


def _between(low: Key | None, high: Key | None) -> Column:
    row = F.struct("k0", "k1", "k2")
    cond = F.lit(True)
    if low is not None:
        cond &= row >= F.struct(*[F.lit(x).cast("bigint") for x in low])
    if high is not None:
        cond &= row < F.struct(*[F.lit(x).cast("bigint") for x in high])
    return cond


def cutoff(keys: DataFrame, take: int, last: int = LAST) -> Key | None:
    """The ``take``-th smallest key (k0, k1, k2) of a stored frame; None for take = 0."""
    if last < 16:
        raise ValueError("last must be at least 16: fewer keys may have a pivot that discards none")
    if take <= 0:
        return None
    low: Key | None = None
    high: Key | None = None
    sides = _round(keys, None, None, None)
    side, remaining = 1, sum(n for _, n in sides[1])
    kept = remaining
    while remaining > last:
        pivot = weighted_median(sides[side])
        sides = _round(keys, low, high, pivot)
        before = sum(n for _, n in sides[0])
        if take <= before:
            high, side, remaining = pivot, 0, before
        else:
            low, side, remaining, take = pivot, 1, remaining - before, take - before
        if last < remaining <= kept // 4:
            keys, kept = stored(keys.where(_between(low, high))), remaining
    left = sorted((r.k0, r.k1, r.k2) for r in keys.where(_between(low, high)).collect())  # ``last`` rows at most
    return left[take - 1]


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Add ``rank`` (1, 2, ... by falling score, ties to the smaller doc_id) to floor(percent % of) the rows with ``min_words`` words."""
    top = F.lit((1 << 63) - 1).cast("bigint")
    scored = stored(scored.withColumn("k0", -F.col("score")).withColumn("k1", F.coalesce(F.col("doc_id").try_cast("bigint"), top))
                    .withColumn("k2", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= min_words
    keys = scored.where(fit).select("k0", "k1", "k2")
    end = cutoff(keys, keys.count() * percent // 100)
    drawn = F.lit(False) if end is None else fit & _between(None, (end[0], end[1], end[2] + 1))
    ranked = consecutive_index(scored.where(drawn), ["k0", "k1", "k2"], name="rank")
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("k0", "k1", "k2")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, ngram: int = 1, buckets: int = 10_000,
              seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document; rank is null where it was not drawn."""
    got = draw(importance(docs, target, ngram, buckets, seed), percent, min_words)
    return got.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
