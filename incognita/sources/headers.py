"""Writing and reading header tables (the engine's input format).

A header table must carry the key columns (``model.KEY_COLUMNS``) next to the
element arrays; ``write_header_table`` derives them, so whatever produces the
parsed headers only has to supply path, root, root_ord, mtime, magic,
parse_error and elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.tags import first_value_anywhere, with_keys


def conform(df: DataFrame) -> DataFrame:
    """Key columns derived from ``elements`` and columns in the canonical order."""
    keyed = with_keys(df)
    # element arrays pass through as produced (their nullability is the producer's)
    return keyed.select(*[F.col(f.name) if f.name == "elements" else F.col(f.name).cast(f.dataType)
                          for f in model.HEADERS.fields])


def write_header_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a header table; files are laid out by the input's partitions (no shuffle)."""
    conform(df).write.mode(mode).parquet(path)


def read_header_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.HEADERS).parquet(path)


def write_bucketed_table(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a header table as catalog table bucketed and sorted by study UID, and return it.

    Joins of its files with the study map then need no shuffle of the files,
    whatever the map's size. Null study UIDs (files that are never joined) are
    dealt to the buckets with the others.
    """
    writer = conform(df).repartition(buckets, "study_uid").write.bucketBy(buckets, "study_uid").sortBy("study_uid").mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def ensure_keys(df: DataFrame) -> DataFrame:
    """Derive the key columns if the table lacks them.

    It lacks them if a column is missing, or if a file has a study UID among its
    elements but none in its key column (files without key columns read with the
    full schema). The test reads only rows whose key column is NULL.
    """
    if any(c not in df.columns for c in model.KEY_COLUMNS):
        return conform(df)
    unset = df.where(F.col("study_uid").isNull() & first_value_anywhere("elements", model.STUDY_INSTANCE_UID).isNotNull())
    return df if unset.isEmpty() else conform(df)
