"""Table of processed files: which version of a file which run finished, under which rules.

    <out_dir>/processed/run_id=<run>/   path, mtime, rules

A run records its files after its output is committed, so a run that
died is done again. A file is up to date if the last run that recorded it saw the
same modification time and the same rules; files that found no free study ID
are not recorded and come again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.operators.registry_ops import bounded_broadcast
from incognita.operators.scrub import Rules
from incognita.sources import registry as store

SCHEMA = "path string, mtime timestamp, rules string, recorded_at timestamp, run_id string"
NEW, CHANGED = "new", "changed"


def rules_digest(rules: Rules) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def record(out_dir: str, files: DataFrame, rules: str, run_id: str) -> None:
    """Note files (path, mtime) as processed; replaces what an earlier try of the run noted."""
    rows = files.select("path", "mtime", F.lit(rules).alias("rules"), F.current_timestamp().alias("recorded_at"), F.lit(run_id).alias("run_id"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
     .parquet(f"{out_dir.rstrip('/')}/processed"))


def read(spark: SparkSession, out_dir: str) -> DataFrame | None:
    path = f"{out_dir.rstrip('/')}/processed"
    return spark.read.schema(SCHEMA).parquet(path) if store.exists(spark, path) else None


def todo(files: DataFrame, done: DataFrame, rules: str) -> DataFrame:
    """(path, status) of the ``files`` (path, mtime) that are new or were processed in another version or by other rules."""
    last = done.groupBy("path").agg(F.max(F.struct("recorded_at", "run_id", "mtime", "rules")).alias("last"))
    seen = files.select("path", "mtime").join(last, "path", "left")
    same = F.col("last.mtime").eqNullSafe(F.col("mtime")) & (F.col("last.rules") == rules)
    status = F.when(F.col("last").isNull(), F.lit(NEW)).when(~same, F.lit(CHANGED))
    return seen.select("path", status.alias("status")).where("status is not null").distinct()


def only_todo(headers: DataFrame, done: DataFrame, rules: str) -> DataFrame:
    """The header rows of the files that ``todo`` names; only paths and times are compared, and paths stored."""
    wanted = todo(headers, done, rules).select("path").checkpoint(eager=True)
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("path")).alias("w")).first()
    return headers.join(bounded_broadcast(wanted, size["n"], (size["w"] or 0) + 48), "path", "left_semi")
