"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.session import ensure_checkpoint_dir

#: Most bytes a broadcast value may take in an executor; every broadcast below is measured against it first.
BROADCAST_BYTES = 64 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame) -> DataFrame:
    """Materialise in ``spark.checkpoint.dir``: survives lost executors, and later reads see the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def raw(name: str) -> Column:
    """UTF-8 bytes of a text column."""
    return col(name).cast("string").cast("binary")


def word_runs(text: bytes, table: bytes, stretch: int) -> Iterator[list[bytes]]:
    """The words of a text that ``table`` maps to word bytes and spaces, in lists that cover about ``stretch`` bytes each."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = at + stretch
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


_BASE = 0x9E3779B97F4A7C15  # odd


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least; a worker keeps the longest."""
    if not _known_powers or len(_known_powers[0]) < n:
        with np.errstate(over="ignore"):
            tables = [np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            for t in tables:
                t[0] = 1
                np.cumprod(t, out=t)
        _known_powers[:] = tables
    return _known_powers


class Hasher:
    """64-bit hashes of any parts of a sequence of numbers, from sums of powers modulo 2**64."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(1 << max(16, int(len(symbols)).bit_length()))
        with np.errstate(over="ignore"):
            symbols = (symbols.astype(np.uint64) + np.uint64(0x1F123BB5)) * np.uint64(0xD6E8FEB86659FD93)
            symbols ^= symbols >> np.uint64(32)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * up[:len(symbols)])])

    def __call__(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[stop] - self.sums[begin]) * self.down[begin]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def hinted(df: DataFrame) -> DataFrame:
    """A stored frame, marked for broadcast if its measured bytes (32 a row added) fit the bound; else joined by shuffle."""
    width = sum((F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(32))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def blob(values: Iterable) -> str:
    """Short digest of parameters, to derive seeds from."""
    return hashlib.sha256(repr(list(values)).encode()).hexdigest()


def seeded(*parts) -> np.random.Generator:
    """A generator fixed by its arguments alone."""
    return np.random.default_rng(int(blob(parts)[:16], 16))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys in sorted arrays."""
    if len(keys[0]) == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Split batches sorted by ``names`` into runs of equal keys: (key, part of a batch, whether the run begins here)."""
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        starts = [*run_starts(*keys).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            key = tuple(k[s] for k in keys)
            yield key, batch.slice(s, e - s), key != last
            last = key


class Forest:
    """Union-find over small integers; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
