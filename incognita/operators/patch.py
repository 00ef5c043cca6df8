"""Targeted tag edits from a patch table.

``apply_patches`` creates or replaces top-level elements, where an empty new
value means "keep". ``set_existing`` changes an element only where it exists.
Both keep every file: the header table is joined (left) with the patch table on
a column of the header table (patient ID by default, or the path, or any other
key column). A key has one patch; with several the last by an order column wins,
or, without one, the edit is refused. The patch table is measured first: it is
broadcast when its bytes fit the budget, else the join shuffles on the key and
AQE splits a hot key (one patient holding many files). ``plans.jobs.apply_edits``
writes the edited headers with their key columns derived anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.tags import element, has_top, is_top, top_value
from incognita.operators.registry_ops import ROW_OVERHEAD_BYTES, bounded_broadcast

# Patch columns of a three-field edit: (tag, keyword, value type).
EDIT_FIELDS = {
    "new_patient_id": (model.PATIENT_ID, "PatientID", "LO"),
    "new_accession": (model.ACCESSION_NUMBER, "AccessionNumber", "SH"),
    "new_study_date": (model.STUDY_DATE, "StudyDate", "DA"),
}

_P = "_patch_"  # prefix of the patch table's columns after the join


class PatchError(ValueError):
    pass


def _upsert(elements, t: int, keyword: str, vr: str, value):
    arr = F.array(F.lit(t).cast("bigint"))
    kept = F.filter(elements, lambda e: e["path_tags"][0] != F.lit(t))
    return F.sort_array(F.concat(kept, F.array(element(arr, arr, F.lit(keyword), F.lit(vr), value))))


def with_key(headers: DataFrame, key: str = "patient_id") -> DataFrame:
    """The header table with the join key: a column it has, or a key column derived from its elements."""
    if key in headers.columns:
        return headers
    if key not in model.KEY_TAGS:
        raise PatchError(f"the header table has no column {key!r} and it is not a key column")
    return headers.withColumn(key, top_value("elements", model.KEY_TAGS[key]))


def single(patches: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One patch per key: the last by ``order``; without it a repeated key is an error."""
    patches = patches.where(F.col(key).isNotNull())
    if order:
        rest = [c for c in patches.columns if c != key]
        last = F.max(F.struct(F.col(order), *[F.col(c) for c in rest if c != order])).alias("_last")
        return patches.groupBy(key).agg(last).select(key, *[F.col("_last")[c].alias(c) for c in rest])
    twice = patches.groupBy(key).count().where("count > 1").limit(3).collect()
    if twice:
        raise PatchError(f"several patches for {key} {', '.join(repr(r[0]) for r in twice)}: give an order column")
    return patches


def _side(patches: DataFrame) -> DataFrame:
    """The patch table with prefixed columns, broadcast when its measured bytes fit the budget."""
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in patches.columns])
    size = patches.agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("w")).first()
    renamed = patches.select(*[F.col(c).alias(_P + c) for c in patches.columns])
    return bounded_broadcast(renamed, size["n"], (size["w"] or 0) + ROW_OVERHEAD_BYTES)


def _joined(headers: DataFrame, patches: DataFrame, key: str, order: str | None) -> DataFrame:
    """Every file with its patch; ``has_patch`` tells whether it has one."""
    side = _side(single(patches, key, order).withColumn("there", F.lit(True)))
    j = with_key(headers, key).join(side, F.col(key) == F.col(_P + key), "left")
    return j.withColumn("has_patch", F.coalesce(_P + "there", F.lit(False))).drop(_P + key, _P + "there")


def _plain(j: DataFrame, keep: list[str]) -> DataFrame:
    return j.select(*keep, *[c for c in j.columns if c not in keep and not c.startswith(_P)])


def apply_patches(headers: DataFrame, patches: DataFrame, fields: dict[str, tuple[int, str, str]] = EDIT_FIELDS,
                  key: str = "patient_id", order: str | None = None) -> DataFrame:
    """Every file with ``has_patch`` and the ``patched`` elements.

    ``fields`` maps a patch column to (tag, keyword, vr); '' or NULL keeps the old value.
    """
    j = _joined(headers, patches, key, order)
    out: Column = F.col("elements")
    for column, (t, kw, vr) in fields.items():
        if column in patches.columns:
            new = F.coalesce(_P + column, F.lit(""))
            out = F.when(new != "", _upsert(out, t, kw, vr, new)).otherwise(out)
    return _plain(j.withColumn("patched", out), headers.columns)


def set_existing(headers: DataFrame, patches: DataFrame, t: int, value_col: str = "new_value",
                 key: str = "patient_id", order: str | None = None, active: str | None = None) -> DataFrame:
    """Every file with its ``status``, the ``patched`` elements and the ``value`` of the tag after the edit.

    status: 'set' (changed), 'absent' (the file lacks the tag), 'inactive' (the
    patch's ``active`` column is not true), 'no_patch'.
    """
    j = _joined(headers, patches, key, order)
    on = F.coalesce(_P + active, F.lit(False)) if active else F.lit(True)
    status = (F.when(~F.col("has_patch"), F.lit("no_patch")).when(~on, F.lit("inactive"))
              .when(has_top("elements", t), F.lit("set")).otherwise(F.lit("absent")))
    j = j.withColumn("status", status)
    updated = F.transform("elements", lambda e: F.when(
        is_top(e) & (e["path_tags"][0] == F.lit(t)),
        element(e["pos"], e["path_tags"], e["keyword"], e["vr"], F.col(_P + value_col))).otherwise(e))
    j = j.withColumn("patched", F.when(F.col("status") == "set", updated).otherwise(F.col("elements")))
    j = j.withColumn("value", F.when(F.col("status") == "set", F.col(_P + value_col)))
    return _plain(j, headers.columns)


def set_report(headers: DataFrame, patches: DataFrame, t: int, value_col: str = "new_value",
               key: str = "patient_id", order: str | None = None, active: str | None = None) -> DataFrame:
    """(path, key, status, value) of the files with a patch, and of the patches without a file ('no_file', path NULL)."""
    hit = (set_existing(headers, patches, t, value_col, key, order, active)
           .where(F.col("status") != "no_patch").select("path", key, "status", "value"))
    # Distinct keys first: map-side partial aggregation collapses a patient
    # holding many files to one row per task before the anti-join shuffle.
    keys = with_key(headers, key).select(key).distinct()
    orphans = single(patches, key, order).join(keys, key, "left_anti").select(
        F.lit(None).cast("string").alias("path"), key, F.lit("no_file").alias("status"),
        F.lit(None).cast("string").alias("value"))
    return hit.unionByName(orphans)
