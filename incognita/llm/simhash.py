"""SimHash near-duplicates by anchor-point covering.

A fingerprint has bit i set if over half of the text's shingle hashes (XXH64)
have it. Fingerprints at most ``max_bits`` apart are linked. To find them, the
64 bits are read as three segments, each with a perfect covering code as
anchors: two binary Golay codes [23,12] (covering radius 3) and a Hamming code
[15,11] with three free bits (radius 1). Of two fingerprints within max_bits,
some segment differs in at most max_bits // 3 bits. There the nearest anchor of
the one (its home) is within radius + max_bits // 3 of the other. So each
fingerprint goes to its home as a probe and is replicated to every anchor within
radius plus threshold, and whole fingerprints are compared per anchor: no link is
missed. From ``WIDE_FROM`` fingerprints on, anchors are pairs of segments (three
pairs, 24 to 26 bits, threshold 2 * max_bits // 3): more replicas, far fewer
comparisons; the links are the same.

Scale: texts are read once; equal fingerprints are one node (combined before the
shuffle). An anchor with more than ``BLOCK`` probes is split into blocks of
probes past which the others stream, so memory is bounded, and a task emits one
edge per fingerprint and block, never all pairs. Components come from
distributed union-find.

Defined cases: null, empty and wordless texts have fingerprint zero, which links
like any other; fewer words than a shingle make one shingle; repeated rows share
a class; a null doc_id is ignored by component_id, which is null only if all are;
ties go to the smallest doc_id, then the smallest fingerprint; an empty table
gives no rows; texts are read in stretches; other columns cannot clash.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from incognita.llm.common import Forest, col, fresh, hinted, raw, runs, stored, word_runs
from incognita.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Probes that a task holds at once.
BLOCK = 1024
#: Fingerprints from which anchors span two segments.
WIDE_FROM = 1 << 22
STRETCH = 1 << 18

#: A-Z to lower case; the six ASCII white-space bytes to a space.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if 0x09 <= c <= 0x0D else c for c in range(256))


def fingerprint(text: bytes | None, n: int = SHINGLE, stretch: int = STRETCH) -> int:
    """Unsigned 64-bit fingerprint."""
    total, ones, carry = 0, np.zeros(64, np.int64), []
    for words in word_runs(text or b"", _WORD, stretch):
        words = carry + words if carry else words
        if len(words) >= n:
            line = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            hashes = b"".join([xxhash.xxh64_digest(line[a:b - 1], SEED) for a, b in zip([0, *ends], ends[n - 1:], strict=False)])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            for part in range(0, len(bits), 1 << 16):
                ones += bits[part:part + (1 << 16)].sum(0, dtype=np.int64)
            total += len(bits)
        carry = words[-(n - 1):] if n > 1 else []
    if total == 0 and carry:
        total, ones = 1, np.unpackbits(np.frombuffer(xxhash.xxh64_digest(b" ".join(carry), SEED), np.uint8)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(n: int = SHINGLE):
    """Column function: bytes to the fingerprint as a signed bigint."""

    @arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), n) for t in texts], np.uint64).view(np.int64))

    return of


@functools.cache
def _syndromes(units: tuple[int, ...]) -> np.ndarray:
    """The syndrome of every value of a segment."""
    table = np.zeros(1 << len(units), np.int16)
    for i, u in enumerate(units):
        np.bitwise_xor(table[:1 << i], u, out=table[1 << i:2 << i])
    return table


class Segment:
    """Bits [low, low + size) with a linear covering code: bit i has the syndrome ``units[i]``."""

    def __init__(self, low: int, units: list[int], radius: int, most: int):
        self.low, self.size, self.radius = low, len(units), radius
        self.table = table = _syndromes(tuple(units))
        # error patterns by syndrome, nearest first: x ^ pattern is a code word (an anchor) at distance |pattern|
        masks = [sum(1 << i for i in c) for w in range(radius + most + 1) for c in itertools.combinations(range(self.size), w)]
        masks = np.array(masks, np.int64)
        order = np.argsort(table[masks], kind="stable")
        self.masks = masks[order]
        self.weights = np.bitwise_count(self.masks).astype(np.int64)
        self.first = np.searchsorted(table[masks][order], np.arange(int(table.max()) + 2))

    def values(self, fp: np.ndarray) -> np.ndarray:
        return ((fp >> np.uint64(self.low)) & np.uint64((1 << self.size) - 1)).astype(np.int64)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return x ^ self.masks[self.first[self.table[x]]]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in x, anchor, distance beyond the radius) of all anchors within radius plus threshold."""
        s = self.table[x]
        n = self.first[s + 1] - self.first[s]
        at = np.repeat(np.arange(len(x)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[s], n)
        return at, x[at] ^ self.masks[k], np.maximum(0, self.weights[k] - self.radius)


def _powers(n: int, g: int, degree: int) -> list[int]:
    """t**i modulo the generator polynomial g, for i < n."""
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x <<= 1
        if x >> degree & 1:
            x ^= g
    return out


@functools.cache
def anchors_of(max_bits: int, wide: bool) -> Anchors:
    """The anchors, built once in a worker."""
    return Anchors(max_bits, wide)


class Anchors:
    """The anchors of fingerprints: keys are numbers, made of the segments used and their code words."""

    def __init__(self, max_bits: int, wide: bool):
        self.max_bits, self.within = max_bits, 2 * max_bits // 3 if wide else max_bits // 3
        golay = _powers(23, 0b101011100011, 11)
        self.segments = [Segment(0, golay, 3, self.within), Segment(23, golay, 3, self.within), Segment(46, [*_powers(15, 0b10011, 4), 0, 0, 0], 1, self.within)]
        self.parts = list(itertools.combinations(range(3), 2 if wide else 1))

    def homes(self, fp: np.ndarray) -> np.ndarray:
        """Keys, len(parts) of them for each fingerprint."""
        own = [s.homes(s.values(fp)) for s in self.segments]
        return np.stack([self._key(p, [own[i] for i in part]) for p, part in enumerate(self.parts)], 1)

    def replicas(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in fp, key) of every anchor within covering radius plus threshold."""
        ats, keys = [], []
        near = [s.near(s.values(fp)) for s in self.segments]
        for p, part in enumerate(self.parts):
            at, anchor, over = near[part[0]]
            words = [anchor]
            for i in part[1:]:
                at2, anchor2, over2 = near[i]
                first = np.searchsorted(at2, np.arange(len(fp) + 1))
                n = (first[1:] - first[:-1])[at]
                row = np.repeat(np.arange(len(at)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
                fits = over[row] + over2[other] <= self.within
                row, other = row[fits], other[fits]
                at, words = at[row], [*(w[row] for w in words), anchor2[other]]
                over = over[row] + over2[other]
            fits = over <= self.within
            ats.append(at[fits])
            keys.append(self._key(p, [w[fits] for w in words]))
        return np.concatenate(ats), np.concatenate(keys)

    def _key(self, p: int, words: list[np.ndarray]) -> np.ndarray:
        key = np.full(len(words[0]), p, np.int64)
        for w in words:
            key = key << 23 | w
        return key


def replicate(nodes: DataFrame, max_bits: int, wide: bool) -> tuple[DataFrame, DataFrame]:
    """(key, fp, role) rows of the probes (role 0, at their homes) and of the replicas (role 1)."""

    def run(probes: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = anchors_of(max_bits, wide)
            for batch in batches:
                fp = batch.column(0).to_numpy().view(np.uint64)
                for a in range(0, len(fp), 4096):
                    part = fp[a:a + 4096]
                    if probes:
                        keys = anchors.homes(part)
                        at, keys = np.repeat(np.arange(len(part)), keys.shape[1]), keys.ravel()
                    else:
                        at, keys = anchors.replicas(part)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at].view(np.int64)), pa.array(np.full(len(at), 0 if probes else 1, np.int8))], names=["key", "fp", "role"])
        return go

    return tuple(nodes.select("fp").mapInArrow(run(p), "key bigint, fp bigint, role tinyint") for p in (True, False))


def blocked(probes: DataFrame, others: DataFrame, block: int, weight: Column | None = None) -> DataFrame:
    """Both with a column ``salt``: keys whose probes weigh more than ``block`` (each 1 by default) have them dealt to blocks, and the others go to each block."""
    total = probes.groupBy("key").agg(F.sum(F.lit(1) if weight is None else weight).alias("w"))
    heavy = stored(total.where(F.col("w") > block).select("key", F.ceil(F.col("w") / block).cast("int").alias("blocks")))
    if heavy.isEmpty():
        return probes.unionByName(others).withColumn("salt", F.lit(0))
    heavy = hinted(heavy)
    n = F.coalesce("blocks", F.lit(1))
    probes = probes.join(heavy, "key", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), n).cast("int")).drop("blocks")
    others = others.join(heavy, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
    return probes.unionByName(others)


def _link(max_bits: int):
    """Edges (a, b) within each (key, salt): probes come first, the others stream past them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, parts, forest, out = np.zeros(0, np.uint64), [], None, []

        def flush(final: bool):
            if forest is not None and final:
                up = np.array([forest.find(i) for i in range(len(probes))])
                other = np.flatnonzero(up != np.arange(len(up)))
                if len(other):
                    out.append((probes[other], probes[up[other]]))
            if out and (final or sum(len(a) for a, _ in out) > 10_000):
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for _, rows, new in runs(batches, ["key", "salt"]):
            if new:
                if (done := flush(True)) is not None:
                    yield done
                probes, parts, forest = np.zeros(0, np.uint64), [], None
            fp, role = rows.column(1).to_numpy().view(np.uint64), rows.column(2).to_numpy()
            n = int(np.searchsorted(role, 1))
            if n:
                parts.append(fp[:n])
            if n == len(fp) or not (parts or len(probes)):
                continue
            if parts:
                probes, parts = np.concatenate(parts), []
            for at in range(n, len(fp), 2048):
                other = fp[at:at + 2048]
                apart = np.bitwise_count(probes[:, None] ^ other[None, :])
                near = (apart <= max_bits) & (apart > 0)
                if not near.any():
                    continue
                forest = forest or Forest(len(probes))
                label, none = np.arange(len(probes)), len(probes)
                while True:  # the smallest probe that each can reach within this part
                    seen = np.where(near, label[:, None], none).min(0)
                    least = np.minimum(label, np.where(near, seen[None, :], none).min(1))
                    if (least == label).all():
                        break
                    label = least
                for p in np.flatnonzero(label != np.arange(none)).tolist():
                    forest.join(p, int(label[p]))
                hit = np.flatnonzero(seen < none)
                a, b = other[hit], probes[seen[hit]]
                out.append((a[a != b], b[a != b]))
                if (done := flush(False)) is not None:
                    yield done
        if (done := flush(True)) is not None:
            yield done

    return go


def links(nodes: DataFrame, max_bits: int = MAX_BITS, wide: bool | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all of the fingerprints ``nodes`` (fp, distinct) within max_bits of each other."""
    wide = nodes.count() >= WIDE_FROM if wide is None else wide
    rows = blocked(*replicate(nodes, max_bits, wide), block)
    return (rows.select("key", "fp", "role", "salt").repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
            .mapInArrow(_link(max_bits), "a bigint, b bigint"))


def classes(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS, wide: bool | None = None, block: int = BLOCK,
            key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, keeper_fp) for every row; the keeper of a class is its (component_id, keeper_fp)."""
    own = stored(docs.select(col(key).alias("doc_id"), fingerprints(n)(raw(text)).alias("fp")))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, max_bits, wide, block))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("component_id"), F.col("fp").alias("keeper_fp"))).alias("k"))
    several = named.where(F.col("root") != F.col("fp")).select("root").distinct()
    best = best.join(several, "root", "left_semi").select("root", "k.component_id", "k.keeper_fp")  # classes of one fingerprint keep their own
    label = named.join(best, "root", "left").select("fp", F.when(F.col("keeper_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
                                                     F.coalesce("keeper_fp", "fp").alias("keeper_fp"))
    return own.join(label, "fp").select("doc_id", "fp", "component_id", "keeper_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Digest per document: doc_id, fingerprint, component_id."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each class, unchanged: that with the smallest doc_id (nulls last), then fingerprint; of repeated rows one."""
    key, fp = fresh(docs, "drop_id", "drop_fp")
    rows = stored(classes(docs, n, max_bits))
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("keeper_fp"))
    gone = stored(rows.where(~keeper).select(F.col("doc_id").alias(key), F.col("fp").alias(fp)).distinct())
    again = stored(rows.where(keeper).groupBy(F.col("doc_id").alias(key), F.col("fp").alias(fp)).count().where("count > 1").drop("count"))
    (own,) = fresh(docs, "own_fp")
    marked = docs.withColumn(own, fingerprints(n).asNondeterministic()(raw("text")))
    same = col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(fp))
    kept = marked.join(hinted(gone), same, "left_anti")
    if not again.isEmpty():
        again = hinted(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.select(*[col(c) for c in docs.columns])
