"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. A row's cell is the top 16 bits of the XXH64 of its
key; every shard has ``VNODES`` virtual nodes on the ring, and a cell belongs to
the first virtual node clockwise. Shards have a capacity in rows: with
``epsilon`` ceil((1 + epsilon) * mean), without it quotas that add up to the
number of rows, so counts differ by one at most. The cells are walked clockwise,
and rows that find their shard full continue clockwise to the next virtual node
whose shard has room. Only overflowing rows leave the shard the ring gives them.

Scale: the text is read once for (key, size, crc, cell), which is stored; counts
by cell (65,536 numbers at most) and by stored partition and shard (at most
``MAX_PARTITIONS`` times a few dozen numbers) come to the driver, rows never do.
Nothing is shuffled but counts, so a hot key costs nothing: its cell is split
among shards by quotas.

Defined cases: a null text has size 1 and the crc of no bytes (0); a null key
has one cell of its own like any value; repeated rows share a cell and each
takes a slot of its own; fewer rows than shards leave shards empty; an empty
table gives no rows; only the key and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm.common import col, raw, stored

CELLS = 1 << 16
VNODES = 160
#: Partitions of the stored rows; more are merged first (each holds rows of a few dozen bytes).
MAX_PARTITIONS = 4096


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise. A shard's nodes stay where they are when others come."""
    points = []
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
            points.append((h, s))
    return [(h >> 48, s) for h, s in sorted(points)]


def capacities(rows: int, shards: int, epsilon: float | None) -> list[int]:
    if epsilon is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(-(-rows * (1 + epsilon) // shards))] * shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Cell -> (shard, rows) in the order in which its rows are dealt."""
    free, cells = list(caps), [c for c, _ in nodes]
    n = len(nodes)
    following = list(range(n))  # the next node clockwise whose shard may have room

    def open_from(i: int) -> int:
        path = []
        for _ in range(2 * n):
            if free[nodes[i][1]] > 0:
                break
            path.append(i)
            i = following[i] if following[i] != i else (i + 1) % n
        for p in path:
            following[p] = i
        return i

    dealt = {}
    for cell in sorted(counts):
        rows, i = counts[cell], bisect.bisect_left(cells, cell) % n
        shares = []
        while rows:
            i = open_from(i)
            shard = nodes[i][1]
            take = min(rows, free[shard])
            if take == 0:
                raise ValueError("the shards' capacities are below the number of rows")
            shares.append((shard, take))
            free[shard] -= take
            rows -= take
        dealt[cell] = shares
    return dealt


def assign(docs: DataFrame, shards: int = 8, epsilon: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, home_shard, shard, slot): slots run from 0 without a gap in each shard."""
    bytes_ = F.coalesce(raw(text), F.lit(b""))
    rows = docs.select(col(key).alias("doc_id"), (F.octet_length(bytes_) + F.lit(1)).cast("bigint").alias("size"), F.crc32(bytes_).alias("text_crc32"),
                       F.shiftrightunsigned(F.xxhash64(col(key)), 48).cast("int").alias("cell"))
    kept = stored(rows)
    if kept.rdd.getNumPartitions() > MAX_PARTITIONS:  # the small rows are merged, never the scan of the texts
        kept = stored(kept.coalesce(MAX_PARTITIONS))
    counts = {r[0]: r[1] for r in kept.groupBy("cell").count().collect()}  # 65,536 rows at most
    nodes = ring(shards)
    dealt = walk(counts, nodes, capacities(sum(counts.values()), shards, epsilon))

    cells = [c for c, _ in nodes]
    home = np.array([nodes[bisect.bisect_left(cells, c) % len(nodes)][1] for c in range(CELLS)], np.int32)
    split = sorted(c for c, shares in dealt.items() if len(shares) > 1)  # no more than the shards that fill up
    group = np.zeros(CELLS, np.int32)  # what a cell's rows are counted under: their shard, or for a split cell a number of its own
    for c, shares in dealt.items():
        group[c] = shares[0][0]
    for k, c in enumerate(split):
        group[c] = shards + k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(shards + len(split), np.int64), None
        for b in batches:
            if b.num_rows:
                at = b.column(1)[0].as_py()
                total += np.bincount(group[b.column(0).to_numpy()], minlength=len(total))
        if at is not None:
            g = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), at), pa.int32()), pa.array(g, pa.int32()), pa.array(total[g])], names=["part", "grp", "n"])

    by_part: dict[int, dict[int, int]] = {}
    for r in kept.select("cell", F.spark_partition_id().alias("part")).mapInArrow(count, "part int, grp int, n bigint").collect():
        by_part.setdefault(r.part, {})[r.grp] = r.n

    # (partition, group) -> (shard, rows, first slot) in order
    used = [0] * shards
    shares = {shards + k: [list(x) for x in dealt[c]] for k, c in enumerate(split)}
    plan: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for part in sorted(by_part):
        for g, n in sorted(by_part[part].items()):
            out = plan.setdefault(part, {}).setdefault(g, [])
            while n:
                if g < shards:
                    shard, take = g, n
                else:
                    share = shares[g][0]
                    shard, take = share[0], min(n, share[1])
                    share[1] -= take
                    if share[1] == 0:
                        shares[g].pop(0)
                out.append((shard, take, used[shard]))
                used[shard] += take
                n -= take
    sent = kept.sparkSession.sparkContext.broadcast((group, home, plan))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, home, plan = sent.value
        seen: dict[int, int] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            cell, part = b.column(3).to_numpy(), b.column(4)[0].as_py()
            g = group[cell]
            shard, slot = np.empty(len(g), np.int32), np.empty(len(g), np.int64)
            for x in np.unique(g).tolist():
                at = np.flatnonzero(g == x)
                rank = seen.get(x, 0) + np.arange(len(at))
                seen[x] = seen.get(x, 0) + len(at)
                to, n, first = (np.array(v) for v in zip(*plan[part][x], strict=True))
                ends = np.cumsum(n)
                k = np.searchsorted(ends, rank, "right")
                shard[at], slot[at] = to[k], first[k] + rank - (ends[k] - n[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home[cell]), pa.array(shard), pa.array(slot)],
                                             names=["doc_id", "size", "text_crc32", "home_shard", "shard", "slot"])

    kind = docs.schema[key].dataType.simpleString()
    return (kept.select("doc_id", "size", "text_crc32", "cell", F.spark_partition_id().alias("part"))
            .mapInArrow(place, f"doc_id {kind}, size bigint, text_crc32 bigint, home_shard int, shard int, slot bigint"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Digest per document under the law ``rows``."""
    got = assign(docs, shards)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
