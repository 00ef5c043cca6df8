"""Study registry in hash buckets: a run reads what its studies touch, not the registry.

    <registry>/study/                            front table (as in ``sources.registry``)
    <registry>/pool/<folder>/segment=<s>/        slots by row number, SEGMENT_ROWS a segment, never rewritten
    <registry>/index/<table>/<folder>/rows/bucket=<b>/    assigned slots, by the hash of a key
    <registry>/index/<table>/<folder>/bloom/bucket=<b>/   one row: a Bloom filter of these keys
    <registry>/commits/v<N>                      one JSON file per version (see ``sources.registry``)
    <registry>/audit_log/                        append-only log

There are two index tables, ``by_uid`` (study UID) and ``by_id`` (study ID). A
commit adds one small file per bucket that it touches. Once ``FANOUT`` files of
one level lie in a bucket they are merged into one of the next level, so a
bucket holds about FANOUT files per factor FANOUT of growth and a row is
rewritten once a level. The commit file names the current files of all buckets;
its size depends on the number of buckets, not on the rows.

A lookup hashes the batch's keys, opens the Bloom filters of their buckets, and
reads only the files whose filter holds one of the keys. Free slots are taken in
row order: the commit file holds a cursor, all free slots before it are given
away, so a run reads the segments from the cursor on until it has enough. A
commit checks what it adds: rows from the cursor on that the pool holds free, no
row, ID or study twice, no study that the index has.

Keys are hashed with XXH64, so buckets grow alike whatever the keys; a bucket's
filter takes BITS bits a key. A file that another writer left behind is named by no
commit file and is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.ranking import consecutive_index
from incognita.operators import registry_ops as reg
from incognita.sources import registry as store
from incognita.sources.registry import RegistryError

BUCKETS = 64
SEGMENT_ROWS = 1 << 16
#: Files of one level in a bucket that are merged into one of the next level.
FANOUT = 8
#: Bits and hash functions of a Bloom filter per key: about one wrong "maybe" in a hundred.
BITS, HASHES = 10, 7

TABLES = {"by_uid": "study_uid", "by_id": "study_id"}
LAYOUT = "buckets"

Entry = list  # [folder, level, rows]
_FILTERS = "number int, n bigint, bits binary, folder string"


# ---- Bloom filters -------------------------------------------------------------

def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each key's bits, one row a hash function."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)])


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, BITS * len(hashes))
    flags = np.zeros(bits, bool)
    flags[_positions(hashes, bits)] = True
    return bits.to_bytes(8, "little") + np.packbits(flags).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> bool:
    """Whether one of the keys may be in the filter."""
    bits = int.from_bytes(filter_[:8], "little")
    flags = np.unpackbits(np.frombuffer(filter_, np.uint8, offset=8), count=bits).astype(bool)
    return bool(flags[_positions(hashes, bits)].all(axis=0).any())


def _blooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter a bucket, from rows (bucket, h) that are sorted by bucket."""
    at, held = None, []

    def done() -> pa.RecordBatch:
        h = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([bloom(h)], pa.binary())], names=["number", "n", "bits"])

    for batch in batches:
        b, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for value in np.unique(b).tolist():
            if at is not None and value != at:
                yield done()
                held = []
            at = value
            held.append(h[b == value])
    if at is not None:
        yield done()


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """(bucket, folder) of the filters that may hold one of the bucket's keys."""
    h = keys.column("h").to_numpy()
    hits = [(b, f) for b, f, bits in zip(filters.column("bucket").to_pylist(), filters.column("folder").to_pylist(), filters.column("bits").to_pylist(), strict=True)
            if len(h) and may_hold(bits, h)]
    return pa.table({"bucket": pa.array([b for b, _ in hits], pa.int32()), "folder": pa.array([f for _, f in hits], pa.string())})


# ---- the registry --------------------------------------------------------------

@dataclass
class BucketRegistry:
    spark: SparkSession
    root: str
    front: dict
    version: int
    content: dict
    files_read: int = 0     # index files that the last lookup opened

    @property
    def n_study_ids(self) -> int:
        return int(self.content["n_study_ids"])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.content["buckets"])).cast("int")

    def _entries(self, table: str, buckets: set[int] | None = None) -> list[tuple[int, Entry]]:
        held = self.content["tables"][table]
        return [(int(b), e) for b, entries in held.items() if buckets is None or int(b) in buckets for e in entries]

    def _path(self, table: str, folder: str, part: str, bucket: int | None = None) -> str:
        base = store._path(self.root, f"index/{table}/{folder}/{part}")
        return base if bucket is None else f"{base}/bucket={bucket}"

    def _rows(self, table: str, files: list[tuple[int, str]]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], model.SLOTS)
        return self.spark.read.schema(model.SLOTS).parquet(*[self._path(table, f, "rows", b) for b, f in files]).select(*model.SLOTS.names)

    # -- reading

    def find(self, table: str, keys: DataFrame) -> DataFrame:
        """Assigned slots whose key is in ``keys`` (one column, named as the table's key)."""
        name = TABLES[table]
        hashed = keys.select(name).where(F.col(name).isNotNull()).distinct().select(name, self._bucket(F.col(name)).alias("bucket"), F.xxhash64(name).alias("h"))
        touched = {r["bucket"] for r in hashed.select("bucket").distinct().collect()}  # no more than the buckets
        entries = self._entries(table, touched)
        files: list[tuple[int, str]] = []
        if entries:
            filters = self.spark.read.schema(_FILTERS).parquet(*[self._path(table, e[0], "bloom", b) for b, e in entries])
            filters = filters.select(F.col("number").alias("bucket"), "folder", "bits")
            hits = hashed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe, "bucket int, folder string").collect()  # buckets x files a bucket
            files = sorted((r["bucket"], r["folder"]) for r in hits)
        self.files_read = len(files)
        return self._rows(table, files).join(hashed.select(name), name, "left_semi").select(*model.SLOTS.names)

    def known(self, studies: DataFrame) -> DataFrame:
        """study_uid, row_no, study_id of those of the ``studies`` that have a slot (a later slot of the same study wins)."""
        return reg.registry_index(self.find("by_uid", studies))

    def free(self, n: int) -> DataFrame:
        """The first ``n`` free slots in row order (fewer if the pool ends): k = 1, 2, ..., row_no, study_id."""
        cursor, rows = int(self.content["cursor"]), int(self.content["segment_rows"])
        out, got, s = None, 0, cursor // rows
        last = max((p[2] for p in self.content["pool"]), default=0) // rows
        step = n // rows + 1
        while got < n and s <= last:
            part = self._segments(s, min(s + step, last + 1)).where(_is_free() & (F.col("row_no") >= cursor)).select("row_no", "study_id")
            got += part.count()
            out = part if out is None else out.unionByName(part)
            s, step = s + step, 2 * step
        if out is None:
            out = self.spark.createDataFrame([], "row_no bigint, study_id string")
        return consecutive_index(out, ["row_no"], name="k").where(F.col("k") <= n)

    def _segments(self, begin: int, end: int) -> DataFrame:
        """Slots of the segments begin <= s < end, as they were when the pool was written."""
        rows = int(self.content["segment_rows"])
        paths = [store._path(self.root, f"pool/{folder}/segment={s}") for folder, first, last in self.content["pool"]
                 for s in range(max(begin, first // rows), min(end, last // rows + 1))]
        paths = [p for p in paths if store.exists(self.spark, p)]  # a pool may have gaps
        return self.spark.read.schema(model.SLOTS).parquet(*paths) if paths else self.spark.createDataFrame([], model.SLOTS)

    def slots(self) -> DataFrame:
        """The whole slot table (for full checks and reports)."""
        used = self._rows("by_id", [(b, e[0]) for b, e in self._entries("by_id")])
        pool = self.spark.read.schema(model.SLOTS).option("recursiveFileLookup", "true").parquet(*[store._path(self.root, f"pool/{folder}") for folder, _, _ in self.content["pool"]])
        return pool.join(used.select("row_no"), "row_no", "left_anti").unionByName(used)

    def stats(self) -> reg.RegistryStats:
        """What the commit file says; nothing is read."""
        used = sum(e[2] for _, e in self._entries("by_id"))
        last = max((p[2] for p in self.content["pool"]), default=0)
        return reg.RegistryStats(self.n_study_ids, int(self.content["n_rows"]), used, int(self.content["cursor"]), int(last))

    # -- writing

    def _add(self, table: str, rows: DataFrame, level: int, tables: dict) -> str:
        """Write rows as one file per bucket with its filter; name them in ``tables``."""
        name, folder = TABLES[table], uuid.uuid4().hex
        keyed = rows.where(F.col(name).isNotNull()).withColumn("bucket", self._bucket(F.col(name))).repartition("bucket")
        keyed.write.mode("errorifexists").partitionBy("bucket").parquet(self._path(table, folder, "rows"))
        written = self.spark.read.schema(f"{name} string, bucket int").parquet(self._path(table, folder, "rows"))
        hashed = written.select("bucket", F.xxhash64(name).alias("h")).repartition("bucket").sortWithinPartitions("bucket")
        filters = hashed.mapInArrow(_blooms, "number int, n bigint, bits binary").select(F.col("number").alias("bucket"), "number", "n", "bits", F.lit(folder).alias("folder"))
        filters.write.mode("errorifexists").partitionBy("bucket").parquet(self._path(table, folder, "bloom"))
        for r in self.spark.read.schema(_FILTERS).parquet(self._path(table, folder, "bloom")).select("number", "n").collect():  # one row a bucket
            tables[table].setdefault(str(r["number"]), []).append([folder, level, r["n"]])
        return folder

    def _merge(self, tables: dict) -> None:
        """Merge the files of a level in the buckets that have ``FANOUT`` of them, until none has."""
        for table in TABLES:
            level = 0
            while level <= max((e[1] for es in tables[table].values() for e in es), default=-1):
                full = {b: [e for e in es if e[1] == level] for b, es in tables[table].items()}
                full = {b: es for b, es in full.items() if len(es) >= FANOUT}
                if full:
                    rows = self._rows(table, [(int(b), e[0]) for b, es in full.items() for e in es])
                    for b, es in full.items():
                        tables[table][b] = [e for e in tables[table][b] if e not in es]
                    self._add(table, rows, level + 1, tables)
                level += 1

    def commit(self, assignments: DataFrame) -> "BucketRegistry":
        """The next version: slots of the assignments (study_uid, row_no, study_id and the registry values) filled."""
        tables = {t: {b: list(es) for b, es in held.items()} for t, held in self.content["tables"].items()}
        fresh = assignments.where(F.col("study_id").isNotNull()).withColumn("assigned_at", F.current_timestamp())
        folder = self._add("by_uid", store._conform(fresh), 0, tables)
        added = self._rows("by_uid", [(int(b), e[0]) for b, es in tables["by_uid"].items() for e in es if e[0] == folder])
        try:
            cursor = self._checked(added)
            self._add("by_id", added, 0, tables)
            self._merge(tables)
            return self._claimed({**self.content, "tables": tables, "cursor": cursor})
        except RegistryError:
            self._drop(tables)
            raise

    def _drop(self, tables: dict) -> None:
        """Delete the folders that only ``tables`` names, not this version: nobody else knows them."""
        for table in TABLES:
            mine = {e[0] for _, e in self._entries(table)}
            for folder in {e[0] for es in tables[table].values() for e in es} - mine:
                store._delete(self.spark, store._path(self.root, f"index/{table}/{folder}"))

    def _checked(self, added: DataFrame) -> int:
        """Refuse slots that may not be filled; returns the cursor after them. Reads the added rows, their segments and index files."""
        a = added.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_no").alias("rows"), F.countDistinct("study_uid").alias("uids"),
                      F.min("row_no").alias("low"), F.max("row_no").alias("high")).first()
        if not a["n"]:
            return int(self.content["cursor"])
        rows, problems = int(self.content["segment_rows"]), []
        if a["rows"] < a["n"] or a["uids"] < a["n"]:
            problems.append("a slot or a study occurs twice")
        if a["low"] < int(self.content["cursor"]):
            problems.append(f"slot {a['low']} is in use")
        pool = self._segments(a["low"] // rows, a["high"] // rows + 1).where(_is_free()).select("row_no", F.col("study_id").alias("pool_id"))
        wrong = added.join(pool, "row_no", "left").where(~F.coalesce(F.col("pool_id") == F.col("study_id"), F.lit(False))).count()
        if wrong:
            problems.append(f"{wrong} slots are not free or have another ID")
        twice = self.find("by_uid", added.select("study_uid")).count()
        if twice:
            problems.append(f"{twice} studies have a slot already")
        if problems:
            raise RegistryError(f"registry {self.root}: the new slots failed checks: " + "; ".join(problems))
        return int(a["high"]) + 1

    def extend(self, slots: DataFrame, n_study_ids: int) -> "BucketRegistry":
        """The next version: more free slots, all after the last row of the pool."""
        piece = _write_pool(self.root, slots, int(self.content["segment_rows"]))
        if piece[1] <= max((p[2] for p in self.content["pool"]), default=0):
            raise RegistryError(f"registry {self.root}: the added slots do not follow row {max(p[2] for p in self.content['pool'])}")
        return self._claimed({**self.content, "pool": [*self.content["pool"], list(piece[:3])], "n_rows": int(self.content["n_rows"]) + piece[3], "n_study_ids": int(n_study_ids)})

    def _claimed(self, content: dict) -> "BucketRegistry":
        store._claim(self.spark, self.root, store._next(self.spark, self.root, self.version), {**content, "parent": self.version})
        return load(self.spark, self.root)


def _is_free() -> Column:
    return ~reg.assigned() & (F.coalesce("study_id", F.lit("")) != "") & (F.col("row_no") >= 2)


def _write_pool(root: str, slots: DataFrame, segment_rows: int) -> tuple[str, int, int, int]:
    """(folder, first row, last row, rows) of slots written by segment."""
    folder = uuid.uuid4().hex
    path = store._path(root, f"pool/{folder}")
    rows = store._conform(slots).withColumn("segment", F.floor(F.col("row_no") / segment_rows).cast("int"))
    rows.repartition("segment").write.mode("errorifexists").partitionBy("segment").parquet(path)
    r = slots.sparkSession.read.schema(model.SLOTS).parquet(path).agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return folder, int(r["a"] or 0), int(r["b"] or 0), int(r["n"])


def create(spark: SparkSession, root: str, title: str, pi: str, slots: DataFrame, n_study_ids: int, irb_code: str = model.DEFAULT_IRB_CODE,
           user: str = "", computer: str = "", creation_messages: list[str] | None = None, buckets: int = BUCKETS,
           segment_rows: int = SEGMENT_ROWS) -> BucketRegistry:
    """Write a new registry in buckets from a slot table (assigned slots enter the index); the slots are checked whole, once."""
    if store.versions(spark, root):
        raise RegistryError(f"registry {root} already exists")
    folder, first, last, n = _write_pool(root, slots, segment_rows)
    pool = spark.read.schema(model.SLOTS).parquet(store._path(root, f"pool/{folder}"))
    store._refuse(pool, n_study_ids, f"registry {root}: the slots")
    store.write_front(spark, root, title, pi, irb_code, n_study_ids)
    content = {"layout": LAYOUT, "parent": 0, "buckets": buckets, "segment_rows": segment_rows, "n_study_ids": int(n_study_ids), "n_rows": n,
               "cursor": 2, "pool": [[folder, first, last]], "tables": {t: {} for t in TABLES}}
    made = BucketRegistry(spark, root, {}, 0, content)
    for table in TABLES:
        made._add(table, pool.where(reg.assigned()), 0, content["tables"])
    store._claim(spark, root, 1, content)
    store.append_log(spark, root, [(model.LOG_NORMAL, m) for m in creation_messages or [model.MSG_STUDY_CREATED.format(title=title, pi=pi)]], user, computer)
    return load(spark, root)


def is_bucketed(spark: SparkSession, root: str) -> bool:
    newest = store.newest(spark, root)
    return bool(newest) and newest[1].get("layout") == LAYOUT


def load(spark: SparkSession, root: str) -> BucketRegistry:
    """The latest version: its commit file and the one-row front table are read, nothing else."""
    newest = store.newest(spark, root)
    if not newest or newest[1].get("layout") != LAYOUT:
        raise RegistryError(f"registry {root} has no version in buckets")
    front = spark.read.parquet(store._path(root, "study")).first().asDict()
    front["n_study_ids"] = newest[1]["n_study_ids"]
    return BucketRegistry(spark, root, front, newest[0], newest[1])


def prune(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Delete all but the newest ``keep`` versions (keep >= 1) and the index folders that only they use; returns the versions.

    Explicit and opt-in, as old versions are the registry's history. Commit files
    go first, so no version is left without its files; folders that no commit file
    names stay, as a writer may be at work on one.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1: the latest version is never deleted")
    contents = {v: c for v, path in store._listed(spark, root).items() if (c := store._content(spark, path))}
    doomed = sorted(contents)[:-keep]

    def folders(versions: list[int]) -> set[tuple[str, str]]:
        return {(t, e[0]) for v in versions for t, held in contents[v]["tables"].items() for es in held.values() for e in es}

    unused = folders(doomed) - folders([v for v in contents if v not in doomed])
    for v in doomed:
        store._delete(spark, store._path(root, f"commits/v{v:010d}"))
    for table, folder in sorted(unused):
        store._delete(spark, store._path(root, f"index/{table}/{folder}"))
    return doomed
