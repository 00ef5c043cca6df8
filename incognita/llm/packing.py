"""Vector best-fit packing of tokenised documents into training sequences.

A piece is a vector of three sizes: tokens, documents (1) and attention cost
(tokens squared). A sequence has a capacity in each and takes a piece only if
all three still fit. Pieces go in by decreasing size, and a rule picks the place:

* ``norm``: of the open sequences with room, the one whose residual, after the
  piece, has the least weighted norm;
* ``dot``: one sequence at a time is filled; of the pieces that fit, the one
  with the greatest weighted dot product with the residual goes in.

Scale: tokenising is one narrow pass (text is never shuffled). The small piece
rows are stored, dealt by a hash of their stored position into groups of about
``group_rows`` (so no key can be hot), and each group is packed by itself; a
group leaves at most a few sequences partly filled. Pieces that fill a sequence
alone skip the groups.

Defined cases: a null or empty text is the end token alone; repeated rows and
null ids are packed like any others; texts of any length are tokenised whole; an
empty table gives no rows; columns of the input other than id and text are not
read. The ids are those that `tokenizers` gives for the file with
add_special_tokens=False: the file's added tokens keep their ids where a text
holds their strings. tiktoken computes them from the file's vocabulary at four
times the speed (the tests compare both).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm.common import col, raw, stored

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together.
GROUP_ROWS = 8192
#: Of tokens, documents and attention cost; the last two only break ties among equally full sequences.
WEIGHTS = (1.0, 1e-3, 1e-3)
_loaded: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer file; its ids are its merge ranks, so they are all that is needed."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes the other bytes as characters from 256 on
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _loaded[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _loaded[path]


def encode(text: str, path: str, special: bool = False) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers; ``special`` gives the strings of added tokens their ids."""
    own = tokenizer(path)
    return np.array(own.encode(text, allowed_special="all") if special else own.encode_ordinary(text), "<u4").tobytes()


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be short."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids): the documents' tokens, each with the end token, cut at ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            kind, keys, values = batch.schema.field(0).type, batch.column(0).to_pylist(), batch.column(1)
            rows, size = [], 0
            for name, value in zip(keys, values, strict=True):
                ids = encode((value.as_py() or b"").decode("utf-8", "replace"), path, special=True) + end
                rows += [(name, i, start, length, ids[4 * start : 4 * (start + length)]) for i, (start, length) in enumerate(cut(len(ids) // 4, capacity))]
                size += len(ids)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return docs.select(col(key).alias("doc_id"), raw(text).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The sequence (0, 1, ...) of each piece of one group, under every capacity."""
    caps, w = np.asarray(capacities, float), np.asarray(weights, float)
    sizes = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    if len(sizes) and (sizes.max(0) > caps).any():
        raise ValueError("a piece is larger than a sequence")
    order = np.argsort(-lengths, kind="stable")
    return (_by_norm if rule == "norm" else _by_dot)(sizes, order, caps, w)


def _by_norm(sizes, order, caps, w):
    place = np.empty(len(sizes), np.int64)
    left, names, n, opened = np.empty((64, 3)), np.empty(64, np.int64), 0, 0
    least = sizes[order[-1], 0] if len(order) else 0
    for step, i in enumerate(order):
        if step % 512 == 0 and n:  # sequences without room for the smallest piece leave
            keep = (left[:n, 0] >= least) & (left[:n, 1] >= 1)
            k = int(keep.sum())
            left[:k], names[:k] = left[:n][keep], names[:n][keep]
            n = k
        after = left[:n] - sizes[i]
        norm = ((after / caps) ** 2) @ w
        norm[(after < 0).any(1)] = np.inf
        best = int(norm.argmin()) if n else -1
        if n == 0 or norm[best] == np.inf:
            if n == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            left[n], names[n], best = caps, opened, n
            n, opened = n + 1, opened + 1
        left[best] -= sizes[i]
        place[i] = names[best]
    return place


def _by_dot(sizes, order, caps, w):
    place = np.empty(len(sizes), np.int64)
    kinds, first, count = np.unique(-sizes[order, 0], return_index=True, return_counts=True)
    shapes, taken, opened = sizes[order[first]], np.zeros(len(kinds), np.int64), 0
    todo = len(order)
    while todo:
        left = caps.copy()
        while True:
            fits = (taken < count) & (shapes <= left).all(1)
            if not fits.any():
                break
            k = int(np.where(fits, ((shapes / caps) * (left / caps)) @ w, -1).argmax())
            place[order[first[k] + taken[k]]] = opened
            taken[k] += 1
            left -= shapes[k]
            todo -= 1
        opened += 1
    return place


def place(rows: DataFrame, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: float = float(CAPACITY) ** 2,
          weights: tuple = WEIGHTS, rule: str = "norm", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``rows`` (any columns; ``length`` is the size) with ``sequence_id`` and the gapless ``offset`` in it."""
    at = stored(rows).withColumn("slot_no", F.monotonically_increasing_id())  # stored partitions: the same in every pass
    whole, part = at.where(F.col("length") >= capacity), at.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_rows))
    caps = (capacity, max_docs, max_attention)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot_no"], ignore_index=True)
        group["sequence_id"] = best_fit(group["length"].to_numpy(), caps, weights, rule)
        group = group.sort_values(["sequence_id", "slot_no"], ignore_index=True)
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        group["sequence_id"] = ((int(group["group_no"].iat[0]) << 32) + group["sequence_id"]) * 2 + 1
        return group[names]

    names = [f.name for f in rows.schema] + ["sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id bigint, offset bigint"
    packed = (part.withColumn("group_no", F.pmod(F.xxhash64("slot_no"), F.lit(groups)).cast("int"))
              .repartition(min(groups, 20_000), "group_no").groupBy("group_no").applyInPandas(pack, schema))
    alone = whole.select(*[col(f.name) for f in rows.schema], (F.col("slot_no") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Digest per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity)
    return place(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
