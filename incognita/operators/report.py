"""Audit log: level filter, sequence numbers and line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.ranking import consecutive_index
from incognita.operators import screen


def level_text(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for lvl, txt in sorted(model.LOG_LEVEL_TEXT.items(), reverse=True):
        out = F.when(level == lvl, F.lit(txt)).otherwise(out)
    return out


def activity(level: Column, message: Column) -> Column:
    """``({level text}): {message}``."""
    return F.concat(F.lit("("), level_text(level), F.lit("): "), message)


def file_events(outcomes: DataFrame) -> DataFrame:
    """Log events of a run, one per file: ts, ord (path), level, message.

    Screened-out files are NORMAL, files without a study UID HIGH, and
    processed files DEBUG.
    """
    o = F.col("outcome")
    level = (F.when(o.isin(screen.SKIPLIST, screen.NOT_DICOM, screen.UNREADABLE, screen.EXHAUSTED),
                    F.lit(model.LOG_NORMAL))
             .when(o == screen.NO_UID, F.lit(model.LOG_HIGH))
             .otherwise(F.lit(model.LOG_DEBUG)))
    message = F.coalesce(F.col("message"), F.concat(F.lit("De-identified "), screen.file_name("path")))
    return outcomes.select("ts", F.col("path").alias("ord"), level.alias("level"), message.alias("message"))


def audit_log(events: DataFrame, global_level: int = model.LOG_NORMAL, first_seq: int = 1,
              user: str = "", computer: str = "") -> DataFrame:
    """Keep events with level <= global_level, number them in (ts, ord) order, format."""
    kept = events.where(F.col("level") <= F.lit(global_level))
    numbered = consecutive_index(kept, ["ts", "ord"], name="seq", start=first_seq)
    return numbered.select(
        "seq",
        F.date_format("ts", "dd-MM-yyyy").alias("log_date"),
        F.date_format("ts", "HH:mm:ss").alias("log_time"),
        F.col("level").cast("int").alias("level"),
        activity(F.col("level"), F.col("message")).alias("activity"),
        F.lit(user).alias("user"), F.lit(computer).alias("computer"))
