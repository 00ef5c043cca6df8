"""De-identified output: one Parquet table partitioned by (root, run_id).

Partition values are read with their schema, so that a root ``007`` stays text.
A file that several runs wrote has one current version: that of the run that
was committed last (``sources/manifest.py``). A rerun under the same run_id replaces
its partitions and removes those it no longer makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita import model
from incognita.sources import manifest
from incognita.sources import registry as store

OUTPUT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("out_path", T.StringType()),
    T.StructField("study_id", T.StringType()),
    T.StructField("elements", T.ArrayType(model.ELEMENT)),
    T.StructField("written_at", T.TimestampType()),
    T.StructField("root", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

OUTCOMES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("root", T.StringType()),
    T.StructField("study_uid", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("run_id", T.StringType()),
])


#: Roots that a task writes side by side; with more of them it sorts the rows that are left.
WRITERS = 8
#: Bytes that each of these collects before it writes them.
ROW_GROUP_BYTES = 32 << 20
_WRITERS_KEY = "spark.sql.maxConcurrentOutputFileWriters"


def write(out_dir: str, files: DataFrame, run_id: str) -> None:
    """Write a run's de-identified files (dynamic partition overwrite).

    A task keeps a file open for each root, so its rows are not sorted by root first: that
    would hold all their element arrays in memory, as many as its share of the headers has.
    """
    conf = files.sparkSession.conf
    before = conf.get(_WRITERS_KEY)
    conf.set(_WRITERS_KEY, str(max(int(before), WRITERS)))
    try:
        _write(out_dir, files, run_id)
    finally:
        conf.set(_WRITERS_KEY, before)


def _write(out_dir: str, files: DataFrame, run_id: str) -> None:
    (files.withColumn("written_at", F.current_timestamp()).withColumn("run_id", F.lit(run_id))
     .select(*[f.name for f in OUTPUT.fields])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("parquet.block.size", str(ROW_GROUP_BYTES)).partitionBy("root", "run_id").parquet(f"{out_dir.rstrip('/')}/headers"))


def remove_stale(spark: SparkSession, out_dir: str, run_id: str, roots: list[str | None]) -> list[str]:
    """Delete this run's partitions of roots for which it wrote nothing; returns their folders."""
    base = f"{out_dir.rstrip('/')}/headers"
    if not store.exists(spark, base):
        return []
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    kept = {"root=" + ("__HIVE_DEFAULT_PARTITION__" if r in (None, "") else escape(r)) for r in roots}
    fs, p = store._fs(spark, base)
    gone = []
    for folder in fs.listStatus(p):
        name = folder.getPath().getName()
        run = f"{base}/{name}/run_id={escape(run_id)}"
        if name.startswith("root=") and name not in kept and store.exists(spark, run):
            store._delete(spark, run)
            gone.append(run)
    return gone


def _rows(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{out_dir.rstrip('/')}/headers")


def commit(spark: SparkSession, out_dir: str, run_id: str) -> manifest.Version | None:
    """Make what a run wrote current, in place of the same files' earlier versions."""
    if not store.exists(spark, f"{out_dir.rstrip('/')}/headers"):
        return None  # no run has written a file yet
    return manifest.commit(spark, _rows(spark, out_dir), out_dir.rstrip("/"), run_id)


def read(spark: SparkSession, out_dir: str, current: bool = True) -> DataFrame:
    """The output table; ``current`` keeps each file's last version only."""
    rows = _rows(spark, out_dir)
    if not current:
        return rows
    version = manifest.newest(spark, out_dir.rstrip("/"))
    return rows.limit(0) if version is None else manifest.current(spark, rows, out_dir.rstrip("/"), version)


def read_outcomes(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(OUTCOMES).parquet(f"{out_dir.rstrip('/')}/outcomes")
