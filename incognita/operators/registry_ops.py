"""Study registry operators: index, lookup, new-study detection, slot assignment.

The registry's slot table has one row per pre-generated study ID
(``row_no`` 2..n+1). A slot is used when it holds both a study ID and a
patient ID. New studies are numbered in first-seen order (root argument
order, then path) and the k-th new study takes the k-th free slot in row order:
one that is not in use and holds an ID, past the nominal pool size too. With no
such slot left the pool is exhausted.

Joins against the registry use a broadcast only when the registry's row
count (known before the join) times a row-size bound fits the broadcast
budget; otherwise they shuffle and AQE's skew handling splits hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.ranking import consecutive_index
from incognita.functions.tags import key_column

# Broadcast budget for registry-sized tables, and a per-row size bound used
# with the registry's row count (UIDs are at most 64 characters, IDs 16).
BROADCAST_BUDGET_KEY = "incognita.broadcast.maxBytes"
DEFAULT_BROADCAST_BUDGET = 128 * 1024 * 1024
REGISTRY_ROW_BYTES = 256
MAX_ID_BYTES = 64          # study IDs: prefix + mask + suffix (16 by the DICOM limit)
ROW_OVERHEAD_BYTES = 48    # hashed-relation row overhead

# Studies that may be taken out of a shuffle as hot.
MAX_HOT_STUDIES = 200

NIL = "Nil"


def assigned(prefix: str = "") -> Column:
    return F.col(prefix + "study_id").isNotNull() & F.col(prefix + "patient_id").isNotNull()


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int = REGISTRY_ROW_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its proven row bound fits the budget."""
    spark = df.sparkSession
    budget = int(spark.conf.get(BROADCAST_BUDGET_KEY, str(DEFAULT_BROADCAST_BUDGET)))
    return F.broadcast(df) if max_rows * row_bytes <= budget else df


@dataclass(frozen=True)
class RegistryStats:
    n_study_ids: int      # nominal pool size (front table)
    n_rows: int           # slot rows present
    n_assigned: int
    first_free: int       # first slot not in use, n+2 when all n are used
    max_row: int

    @property
    def bound(self) -> int:
        return max(self.n_rows, 1)


def registry_stats(slots: DataFrame, n_study_ids: int) -> RegistryStats:
    """One aggregate over the slot table (the reference's load-time scan)."""
    last = n_study_ids + 1
    r = slots.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(assigned(), 1)).alias("n_assigned"),
        F.min(F.when(~assigned() & (F.col("row_no") >= 2) & (F.col("row_no") <= last), F.col("row_no"))).alias("ff"),
        F.max("row_no").alias("max_row"),
    ).first()
    first_free = r["ff"] if r["ff"] is not None else last + 1
    return RegistryStats(n_study_ids, int(r["n_rows"]), int(r["n_assigned"]), int(first_free),
                         int(r["max_row"] or 0))


def first_free_slot(slots: DataFrame, n_study_ids: int) -> DataFrame:
    """First slot not in use (lazy one-row frame); n+2 when every slot is used."""
    last = n_study_ids + 1
    ff = F.min(F.when(~assigned() & (F.col("row_no") >= 2) & (F.col("row_no") <= last), F.col("row_no")))
    return slots.agg(F.coalesce(ff, F.lit(last + 1)).cast("bigint").alias("first_free_row"))


def registry_index(slots: DataFrame) -> DataFrame:
    """study_uid -> (row_no, study_id); a later duplicate UID wins."""
    used = slots.where(assigned() & F.col("study_uid").isNotNull())
    return used.groupBy("study_uid").agg(
        F.max("row_no").alias("row_no"),
        F.max_by("study_id", "row_no").alias("study_id"))


def study_firsts(files: DataFrame) -> DataFrame:
    """One row per study: its first file (root order, then path) and its number of files.

    Partial aggregation runs map-side, so a study holding a large share of
    all files still reaches the shuffle as one row per map task. Only the study
    UID and the path are carried, so nothing else of a patient is ever stored
    while studies are numbered (see ``with_values``).
    """
    first = F.min(F.struct("root_ord", "path")).alias("f")
    return files.groupBy("study_uid").agg(first, F.count(F.lit(1)).alias("n_files")).select("study_uid", "f.*", "n_files")


def with_values(assignments: DataFrame, files: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Add the registry values of each study's first file; at most ``max_rows`` of ``row_bytes`` are joined to the files."""
    side = bounded_broadcast(assignments, max_rows, row_bytes)
    vals = [F.coalesce(key_column(files, c), F.lit(NIL)).alias(c) for c in model.KEY_TAGS]
    rows = files.select("study_uid", "path", *vals).join(side, ["study_uid", "path"])
    return rows.dropDuplicates(["study_uid"])  # a path that occurs twice counts once


def new_studies(firsts: DataFrame, index: DataFrame) -> DataFrame:
    return firsts.join(index.select("study_uid"), "study_uid", "left_anti")


def free_slots(slots: DataFrame) -> DataFrame:
    """Slots that can be given to a study, numbered ``k`` = 1, 2, ... in row order."""
    free = slots.where(~assigned() & (F.coalesce("study_id", F.lit("")) != "") & (F.col("row_no") >= 2))
    return consecutive_index(free.select("row_no", "study_id"), ["row_no"], name="k")


def assign_slots(new: DataFrame, slots: DataFrame, stats: RegistryStats) -> DataFrame:
    """Give the k-th new study (first-seen order) the k-th free slot of a slot table."""
    return give_slots(ranked_studies(new), free_slots(slots), stats.bound, stats)


def ranked_studies(new: DataFrame) -> DataFrame:
    return consecutive_index(new, ["root_ord", "path", "study_uid"], name="k")


def give_slots(ranked: DataFrame, free: DataFrame, bound: int, stats: RegistryStats) -> DataFrame:
    """Join studies and free slots (at most ``bound``) that are both numbered k = 1, 2, ...

    Output: study_uid, k, row_no, study_id (both NULL = exhausted), over_pool flag
    (the slot lies past the nominal pool size). ``with_values`` adds the registry values.
    """
    joined = ranked.join(bounded_broadcast(free, bound), "k", "left")
    return joined.withColumn("over_pool", F.coalesce(F.col("row_no") > F.lit(stats.n_study_ids + 1), F.lit(False)))


def study_map(index: DataFrame, assignments: DataFrame) -> DataFrame:
    """All studies with an ID after this run: known ones and newly assigned ones."""
    known = index.select("study_uid", "study_id", "row_no")
    fresh = assignments.where(F.col("study_id").isNotNull()).select("study_uid", "study_id", "row_no")
    return known.unionByName(fresh)


def hot_studies(firsts: DataFrame, n_files: int, most: int = MAX_HOT_STUDIES) -> list[str]:
    """UIDs of the studies that hold at least one ``most``-th of all files: no more than ``most`` of them."""
    share = max(2, -(-n_files // most))
    return [r[0] for r in firsts.where(F.col("n_files") >= share).select("study_uid").collect()]


def lookup(files: DataFrame, mapping: DataFrame, bound: int, row_bytes: int = REGISTRY_ROW_BYTES,
           hot: list[str] | None = None) -> DataFrame:
    """Attach study_id / row_no to each file by its study UID (left join).

    Within the budget the map is broadcast. Past it, files of the ``hot`` studies
    (a bounded list) still get a broadcast of theirs, and the others are joined by
    study UID: without moving them if the header table is bucketed by study UID
    (``sources.headers.write_bucketed_table``), else by a shuffle.
    """
    small = bounded_broadcast(mapping, bound, row_bytes)
    if small is not mapping or not hot:
        return files.join(small, "study_uid", "left")
    is_hot = F.coalesce(F.col("study_uid").isin(*hot), F.lit(False))
    apart = files.where(is_hot).join(F.broadcast(mapping.where(is_hot)), "study_uid", "left")
    return files.where(~is_hot).join(mapping.where(~is_hot), "study_uid", "left").unionByName(apart)


def commit(slots: DataFrame, assignments: DataFrame, assigned_at: Column | None = None,
           bound: int | None = None) -> DataFrame:
    """Registry after the run: old rows plus the newly filled slots.

    A slot that is in use is never given to another study: that fails the job.
    ``bound`` is a proven upper bound on the assignments (the counted studies
    of the batch); with it the new rows are broadcast into the slot table.
    """
    assigned_at = F.current_timestamp() if assigned_at is None else assigned_at
    fresh = assignments.where(F.col("study_id").isNotNull()).select(
        "row_no",
        assigned_at.cast("timestamp").alias("_assigned_at"),
        *[F.col(c).alias("_" + c) for c in model.SLOT_VALUE_COLUMNS])
    j = slots.join(bounded_broadcast(fresh, bound) if bound else fresh, "row_no", "left")
    taken = F.raise_error(F.concat(F.lit("registry slot is in use: row "), F.col("row_no").cast("string")))
    is_new = F.when(F.col("_study_uid").isNotNull() & assigned(), taken.cast("boolean")).otherwise(F.col("_study_uid").isNotNull())
    cols = []
    for f in model.SLOTS.fields:
        c = f.name
        if c == "assigned_at":
            cols.append(F.when(is_new, F.col("_assigned_at")).otherwise(F.col(c)).alias(c))
        elif c in model.SLOT_VALUE_COLUMNS:
            cols.append(F.when(is_new, F.col("_" + c)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def changed_slots(slots: DataFrame, assignments: DataFrame, bound: int | None = None) -> DataFrame:
    """Only the rows of ``commit`` that the run fills."""
    filled = assignments.where(F.col("study_id").isNotNull()).select("row_no")
    side = bounded_broadcast(filled, bound, 16) if bound else filled
    return commit(slots.join(side, "row_no", "left_semi"), assignments, bound=bound)


def reidentify(deidentified: DataFrame, slots: DataFrame, bound: int) -> DataFrame:
    """Pseudonym -> original patient and study (inner join on the study ID)."""
    reg = slots.where(assigned()).select(
        "study_id", F.col("patient_id").alias("original_patient_id"),
        F.col("study_uid").alias("original_study_uid"), "row_no")
    return deidentified.join(bounded_broadcast(reg, bound), "study_id", "inner")
