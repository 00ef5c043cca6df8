"""Which rows of the de-identified output are current: one small commit file per run.

    <out_dir>/headers/root=../run_id=../   the rows, replaced only by their own run
    <out_dir>/vectors/<folder>/            replaced rows: run_id, file, bucket, bitmap
    <out_dir>/commits/v<N>                 runs in the order they were committed, their
                                           rows, and the vector folder of this version

A run's rows are current until a later commit writes the same path. The commit
finds the rows it replaces by path and notes their positions in their Parquet files
as bitmaps of 32,768 rows. A reader therefore scans the runs that still have
current rows and drops replaced positions by (file, bucket): no paths are joined
and no element array is moved. Runs without a current row are not scanned.

A new run reads the paths of the rows before it, and nothing else of them. A run
committed again takes its place as the last one and all bitmaps are made anew, so
rows that its earlier try replaced come back if it no longer makes them. Rows
without a path replace nothing. A run that died before its commit is not read.
Of two writers that claim a version, the second starts over from the first's.
Bitmaps name files that hold a job's unique ID, so those of files that are gone match nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.operators.registry_ops import bounded_broadcast
from incognita.sources import registry as store

VECTORS = "run_id string, file string, bucket bigint, n_bits int, bitmap binary"

#: Bytes of a vector's row beside its file name and bitmap.
VECTOR_ROW_BYTES = 64

#: Writers that commit at once before a run gives up.
ATTEMPTS = 20


@dataclass
class Version:
    number: int
    runs: list[dict]  # {"run_id", "n_rows", "live"} in commit order
    vectors: str | None
    n_vectors: int
    max_bytes: int

    @property
    def live(self) -> list[str]:
        return [r["run_id"] for r in self.runs if r["live"]]


def newest(spark: SparkSession, out_dir: str) -> Version | None:
    found = store.newest(spark, out_dir)
    if found is None:
        return None
    number, content = found
    return Version(number, content["runs"], content["vectors"], content["n_vectors"], content["max_bytes"])


def _file() -> Column:
    """Partition folders and name of a row's file; the same wherever the table lies."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -3)


def _place() -> list[Column]:
    number = F.col("_metadata.row_index") + 1  # bitmap functions count values from 1
    return [_file().alias("file"), F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).cast("int").alias("bit")]


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def current(spark: SparkSession, rows: DataFrame, out_dir: str, version: Version) -> DataFrame:
    """The current rows of a version; ``rows`` is the scan of all runs."""
    live = rows.where(F.col("run_id").isin(version.live))
    if version.vectors is None:
        return live
    vectors = _read(spark, out_dir, version.vectors).select("file", "bucket", "bitmap")
    dead = bounded_broadcast(vectors, version.n_vectors, version.max_bytes + VECTOR_ROW_BYTES)
    placed = live.select(*rows.columns, *_place())
    return placed.join(dead, ["file", "bucket"], "left").where(~_is_set(F.col("bitmap"), F.col("bit"))).select(*rows.columns)


def _read(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(f"{out_dir}/vectors/{name}")


def _bitmaps(dead: DataFrame) -> DataFrame:
    return dead.groupBy("run_id", "file", "bucket").agg((F.max("bit") + 1).alias("n_bits"), F.bitmap_construct_agg("bit").alias("bitmap"))


def _replaced_by(spark: SparkSession, rows: DataFrame, run_id: str, others: list[str]) -> DataFrame:
    """Places of the rows of ``others`` whose path a new run writes."""
    paths = rows.where(F.col("run_id") == run_id).select("path").where("path is not null").distinct()
    size = paths.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("path")).alias("w")).first()
    old = rows.where(F.col("run_id").isin(others)).select("path", "run_id", *_place())
    return old.join(bounded_broadcast(paths, size["n"], (size["w"] or 0) + VECTOR_ROW_BYTES), "path", "left_semi")


def _replaced(rows: DataFrame, order: list[str]) -> DataFrame:
    """Places of all rows whose path a later run of ``order`` writes too."""
    nth = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("run_id"))
    placed = rows.where(F.col("run_id").isin(order)).where("path is not null").select("path", "run_id", nth.alias("nth"), *_place())
    last = placed.groupBy("path").agg(F.max("nth").alias("last"))
    return placed.join(last, "path").where("nth < last")


def _first_runs(rows: DataFrame, run_id: str) -> list[str]:
    """Runs of a table without commit files, in the order they were written."""
    times = rows.where(F.col("run_id") != run_id).groupBy("run_id").agg(F.max("written_at").alias("at"))
    return [r["run_id"] for r in times.orderBy("at", "run_id").collect()]  # one row per run


def commit(spark: SparkSession, rows: DataFrame, out_dir: str, run_id: str) -> Version:
    """Make a run's rows current; ``rows`` is the scan of all runs, read after the run's were written."""
    for _ in range(ATTEMPTS):
        try:
            return _commit(spark, rows, out_dir, run_id)
        except Outrun:
            continue
    raise store.RegistryError(f"{out_dir}: {ATTEMPTS} other writers committed before run {run_id}")


class Outrun(RuntimeError):
    """Another writer claimed the version."""


def _commit(spark: SparkSession, rows: DataFrame, out_dir: str, run_id: str) -> Version:
    last = newest(spark, out_dir)
    before = last.runs if last else [{"run_id": r, "live": True} for r in _first_runs(rows, run_id)]
    order = [r["run_id"] for r in before if r["run_id"] != run_id] + [run_id]
    if last is None or len(order) == len(before):  # not told yet, or this run's earlier rows are gone
        vectors = _bitmaps(_replaced(rows, order)) if len(order) > 1 else None  # a first run replaces nothing
        counts = {r["run_id"]: r["n"] for r in rows.where(F.col("run_id").isin(order)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        vectors = _bitmaps(_replaced_by(spark, rows, run_id, last.live)) if last.live else None
        counts = {r["run_id"]: r["n_rows"] for r in before} | {run_id: rows.where(F.col("run_id") == run_id).count()}
        if last.vectors and vectors is not None:
            both = _read(spark, out_dir, last.vectors).where(F.col("run_id").isin(last.live)).unionByName(vectors)
            vectors = both.groupBy("run_id", "file", "bucket").agg(F.max("n_bits").alias("n_bits"), F.bitmap_or_agg("bitmap").alias("bitmap"))
    name, n, width, dead = None, 0, 0, {}
    if vectors is not None:
        name = uuid.uuid4().hex
        cut = F.substring("bitmap", F.lit(1), F.ceil(F.col("n_bits") / 8).cast("int"))
        vectors.select("run_id", "file", "bucket", "n_bits", cut.alias("bitmap")).write.mode("errorifexists").parquet(f"{out_dir}/vectors/{name}")
        stats = _read(spark, out_dir, name).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.bitmap_count("bitmap")).alias("dead"),
                                                                  F.max(F.length("bitmap") + F.octet_length("file")).alias("width")).collect()  # one row per run
        n, width = sum(r["n"] for r in stats), max((r["width"] for r in stats), default=0)
        dead = {r["run_id"]: r["dead"] for r in stats}
        if not n:
            store._delete(spark, f"{out_dir}/vectors/{name}")
            name = None
    ended = {r["run_id"] for r in before if not r["live"]} if last and len(order) > len(before) else set()
    runs = [{"run_id": r, "n_rows": int(counts.get(r, 0)), "live": r not in ended and counts.get(r, 0) > dead.get(r, 0)} for r in order]
    number = store._next(spark, out_dir, last.number if last else 0)
    content = {"runs": runs, "vectors": name, "n_vectors": int(n), "max_bytes": int(width), "parent": last.number if last else 0}
    if not store._create_new(spark, f"{out_dir}/commits/v{number:010d}", json.dumps(content)):
        if name:
            store._delete(spark, f"{out_dir}/vectors/{name}")
        raise Outrun
    return Version(number, runs, name, int(n), int(width))


def prune(spark: SparkSession, out_dir: str, keep: int = 10) -> list[int]:
    """Delete all but the newest ``keep`` commit files and the vectors that only they name; rows stay."""
    if keep < 1:
        raise ValueError("keep must be at least 1: the latest version is never deleted")
    commits = {v: c for v, path in store._listed(spark, out_dir).items() if (c := store._content(spark, path))}
    doomed = sorted(commits)[:-keep]
    kept = {c["vectors"] for v, c in commits.items() if v not in doomed}
    for v in doomed:
        store._delete(spark, f"{out_dir}/commits/v{v:010d}")
    for name in {commits[v]["vectors"] for v in doomed} - kept - {None}:
        store._delete(spark, f"{out_dir}/vectors/{name}")
    return doomed
