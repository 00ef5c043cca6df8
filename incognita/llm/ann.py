"""Approximate nearest neighbours by shifted space-filling curves.

Nearness is the largest inner product. Every vector gets one more component,
sqrt(M**2 - |x|**2) with M the largest norm, and queries are scaled to norm M, so
that the largest inner product is the least distance. Each of ``CURVES`` random
orthogonal projections to ``AXES`` axes is standardised, shifted at random and
mapped to its place on a Hilbert curve. The orderings are range-partitioned and
numbered in Spark; a query is compared with all rows up to ``SHARE`` / 2 of the
table (``LEAST`` rows at least) before and after it on each curve; what the curves
find is merged, and the original vectors decide the ranks in double precision.

Scale: the windows of one stretch of ``SPAN`` places stream past its queries in
order of place, so a task holds the queries of one stretch and one batch, and
emits k rows per query and curve. Of equal vectors only the k + 1 with the smallest
ids can be among the k nearest of any query; the others are left out as
candidates (not as queries) before the curves are built, which is exact and
keeps a hot vector from filling windows. For vectors without cluster structure
the windows must be a share of the table to reach the wanted recall, so the work
grows with its square; set ``share`` to 0 and ``least`` to a number of rows for
clustered vectors.

Defined cases: rows with a null id take no part, nor do vectors that are null,
empty, zero or hold null or non-finite components; a repeated id counts once, with
its smallest vector; shorter vectors are padded with zeros; ties go to the smaller
id; with fewer than k candidates all are returned; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions.ranking import consecutive_index
from incognita.llm.common import col, runs, seeded, stored

CURVES = 8
AXES = 3
BITS = 16
SHARE = 0.2
LEAST = 2048
SPAN = 8192


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates below 2**bits, shape (n, axes)."""
    x = points.astype(np.uint64).T.copy()
    axes, zero, one = len(x), np.uint64(0), np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns of the cells, from the largest down
        q, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(axes):
            on = (x[i] & q) != zero
            swap = np.where(on, zero, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, axes):  # Gray code across the axes
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << b), np.uint64((1 << b) - 1), zero)
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << one | (x[i] >> np.uint64(b) & one)
    return place


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, one per id, padded to one length."""
    v = col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    short, long = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if short == long:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(long) - F.size("v"))))


def _projected(rows: DataFrame, size: int, top: float, curves: int, axes: int, seed: int, made):
    """Run ``made(projections of the batch, batch)`` over (vec_id, v, role) rows: role 0 queries, 1 candidates."""
    bases = [np.linalg.qr(seeded("curve", seed, c).normal(size=(size + 1, size + 1)))[0][:, :axes] for c in range(curves)]
    basis = np.concatenate(bases, 1)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, role = _matrix(batch.column(1)), batch.column(2).to_numpy()
                norm = np.sqrt((v * v).sum(1))
                more = np.where(role == 0, 0.0, np.sqrt(np.maximum(0.0, top * top - norm * norm)))
                v = np.concatenate([v * np.where(role == 0, top / norm, 1.0)[:, None], more[:, None]], 1)
                yield from made(v @ basis, batch)

    return go


def curve_rows(rows: DataFrame, size: int, curves: int, axes: int, bits: int, seed: int) -> DataFrame:
    """(curve, key, vec_id, v, role) for every row on every curve."""
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5

    def sums(y, batch):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(y.shape[1], dtype=np.int32)), pa.array(y.sum(0)), pa.array((y * y).sum(0)), pa.array(np.full(y.shape[1], len(y)))], names=["i", "s", "q", "n"])

    moments = (rows.mapInArrow(_projected(rows, size, top, curves, axes, seed, sums), "i int, s double, q double, n bigint")
               .groupBy("i").agg(F.sum("s"), F.sum("q"), F.sum("n")).orderBy("i").collect())  # curves times axes rows
    mean = np.array([m[1] / m[3] for m in moments])
    spread = np.sqrt(np.maximum(1e-18, np.array([m[2] / m[3] for m in moments]) - mean**2))
    shift = seeded("shift", seed).uniform(-0.5, 0.5, len(mean))

    def keys(y, batch):
        cells = np.clip(((y - mean) / spread + shift + 4) / 8, 0, 1 - 1e-9) * (1 << bits)
        for c in range(curves):
            place = hilbert(cells[:, c * axes:(c + 1) * axes].astype(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), c, np.int32)), pa.array(place.view(np.int64)), batch.column(0), batch.column(1), batch.column(2)], names=["curve", "key", "vec_id", "v", "role"])

    return rows.mapInArrow(_projected(rows, size, top, curves, axes, seed, keys), "curve int, key bigint, vec_id bigint, v array<double>, role tinyint")


def _search(k: int, window: int):
    """The k best of each query in its windows; the queries of a stretch come first, then candidates by place."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = [], None

        def close():
            if best is not None:
                row, score, other = best
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(other), pa.array(score)], names=["query_id", "vec_id", "score"])

        for _, part, new in runs(batches, ["curve", "stretch"]):
            if new:
                yield from close()
                queries, best = [], None
            role = part.column(2).to_numpy()
            n = int(np.searchsorted(role, 1))
            if n:
                queries.append((part.column(3).to_numpy()[:n], part.column(4).to_numpy()[:n], _matrix(part.column(5).slice(0, n))))
            if n == len(role) or not queries:
                continue
            if best is None:
                at, ids, q = (np.concatenate(x) for x in zip(*queries, strict=True))
                best, least = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), np.full(len(at), -np.inf)
            for a in range(n, len(role), 2048):
                place, name, v = part.column(3).to_numpy()[a:a + 2048], part.column(4).to_numpy()[a:a + 2048], _matrix(part.column(5).slice(a, 2048))
                lo, hi = np.searchsorted(at, [place[0] - window, place[-1] + window + 1])
                if lo == hi:
                    continue
                scores = q[lo:hi] @ v.T
                scores[ids[lo:hi, None] == name[None, :]] = -np.inf
                bar = least[lo:hi]
                if len(place) > k:
                    bar = np.maximum(bar, np.partition(scores, -k, axis=1)[:, -k])
                row, other = np.nonzero((scores >= bar[:, None] - 1e-9) & (scores > -np.inf))
                row = row + lo
                exact = np.einsum("ij,ij->i", q[row], v[other])
                row, score, other = (np.concatenate(x) for x in zip(best, (row, exact, name[other]), strict=True))
                order = np.lexsort((other, -score, row))
                row, score, other = row[order], score[order], other[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                best = row[keep], score[keep], other[keep]
                least[row[rank == k - 1]] = score[rank == k - 1]
        yield from close()

    return go


def nearest(vectors: DataFrame, every: int, k: int = 20, curves: int = CURVES, axes: int = AXES, bits: int = BITS, share: float = SHARE,
            least: int = LEAST, span: int = SPAN, seed: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows whose id is divisible by ``every``."""
    rows = usable(vectors, key, vector)
    size = rows.select(F.size("v")).first()
    if size is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "v", F.lit(1).cast("tinyint").alias("role"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.lit(0).cast("tinyint").alias("role"))
    both = stored(candidates.unionByName(queries))
    n = both.count()
    window = max(least, int(share * n / 2))
    placed = consecutive_index(curve_rows(both, size[0], curves, axes, bits, seed), ["curve", "key", "role", "vec_id"], "place", 0)
    placed = placed.withColumn("place", F.col("place") - F.col("curve").cast("bigint") * n)  # every curve has all n rows
    asked = placed.where("role = 0").withColumn("stretch", F.expr(f"place div {span}"))
    seen = placed.where("role = 1").withColumn("stretch", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.expr(f"(place - {window}) div {span}")), F.least(F.lit((n - 1) // span), F.expr(f"(place + {window}) div {span}")))))
    found = (asked.unionByName(seen).select("curve", "stretch", "role", "place", "vec_id", "v").repartition("curve", "stretch").sortWithinPartitions("curve", "stretch", "role", "place")
             .mapInArrow(_search(k, window), "query_id bigint, vec_id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
