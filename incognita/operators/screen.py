"""File screening: skip list, magic number, unreadable, missing study UID (narrow)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.tags import first_value_anywhere, has_top

# Outcome labels, in the order the screens are applied.
SKIPLIST, NOT_DICOM, UNREADABLE, NO_UID, OK = "skiplist", "not_dicom", "unreadable", "no_uid", "ok"
# Outcomes decided later, by the study assignment.
EXHAUSTED = "exhausted"

# Report messages (fixed formats): file name followed by the reason.
MSG_NOT_DICOM = ": fourcc failed- non-dicom"
MSG_UNREADABLE = ": load failed- non-dicom"
MSG_NO_UID = " -No studyUID"


def file_name(path: Column | str) -> Column:
    """Last path component, for '/' or '\\' separators."""
    p = F.col(path) if isinstance(path, str) else path
    return F.substring_index(F.translate(p, "\\", "/"), "/", -1)  # compiled; a pattern is tried from every character on


def parent_dir(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"^(.*)[/\\][^/\\]*$", 1)


def study_uid(elements: Column | str = "elements") -> Column:
    """First StudyInstanceUID in preorder, at any depth."""
    return first_value_anywhere(elements, model.STUDY_INSTANCE_UID)


def classify(headers: DataFrame) -> DataFrame:
    """Add ``study_uid``, ``outcome`` and ``message``; the first failing screen decides."""
    name = file_name("path")
    out = headers if "study_uid" in headers.columns else headers.withColumn("study_uid", study_uid("elements"))
    outcome = (F.when(name.isin(*model.SKIP_LIST), F.lit(SKIPLIST))
               .when(F.coalesce(F.col("magic"), F.lit("")) != model.MAGIC, F.lit(NOT_DICOM))
               .when(F.col("parse_error").isNotNull(), F.lit(UNREADABLE))
               .when(F.coalesce(F.col("study_uid"), F.lit("")) == "", F.lit(NO_UID))
               .otherwise(F.lit(OK)))
    out = out.withColumn("outcome", outcome)
    message = (F.when(F.col("outcome") == SKIPLIST, name)
               .when(F.col("outcome") == NOT_DICOM, F.concat(name, F.lit(MSG_NOT_DICOM)))
               .when(F.col("outcome") == UNREADABLE, F.concat(name, F.lit(MSG_UNREADABLE)))
               .when(F.col("outcome") == NO_UID, F.concat(name, F.lit(MSG_NO_UID))))
    return out.withColumn("message", message)


def loaded() -> Column:
    """Files whose header was read (they get tag warnings and count as valid)."""
    return F.col("outcome").isin(NO_UID, OK)


def missing_checklist(df: DataFrame) -> Column:
    """Checklist keywords absent at top level, in checklist order (present-but-empty passes).

    Uses the key columns when the table has them (no element arrays read).
    """
    def absent(k):
        key = model.CHECKLIST_KEYS[k]
        return F.col(key).isNull() if key in df.columns else ~has_top("elements", model.KEYWORD_TAGS[k])
    return F.array_compact(F.array(*[F.when(absent(k), F.lit(k)) for k in model.TAG_CHECKLIST]))


def tag_warnings(classified: DataFrame) -> DataFrame:
    """One row per loaded file with at least one missing checklist tag."""
    w = classified.where(loaded()).select("path", missing_checklist(classified).alias("missing"))
    return w.where(F.size("missing") > 0).select(
        "path",
        F.array_join("missing", " ").alias("missing_tags"),
        F.size("missing").cast("bigint").alias("n_missing"),
    )


CANDIDATE = "candidate"


def prescreen(files: DataFrame) -> DataFrame:
    """Screen raw files before any parsing: skip list, then magic bytes.

    ``files`` is a file inventory with ``magic`` (see ``sources.files.with_magic``).
    Candidates go on to the header parser; the others are reported with the
    same messages as ``classify``.
    """
    name = file_name("path")
    outcome = (F.when(name.isin(*model.SKIP_LIST), F.lit(SKIPLIST))
               .when(F.coalesce(F.col("magic"), F.lit("")) != model.MAGIC, F.lit(NOT_DICOM))
               .otherwise(F.lit(CANDIDATE)))
    out = files.withColumn("outcome", outcome)
    message = (F.when(F.col("outcome") == SKIPLIST, name)
               .when(F.col("outcome") == NOT_DICOM, F.concat(name, F.lit(MSG_NOT_DICOM))))
    return out.withColumn("message", message)
