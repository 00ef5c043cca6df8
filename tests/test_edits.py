"""Edits keep every file, never overwrite a column, and are written back with fresh keys."""

import pytest
from helpers import el, frame, header
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import patch
from incognita.plans import jobs
from incognita.sources.headers import read_header_table


def files(spark):
    def one(i, pid, acc):
        els = [el([model.STUDY_DATE], "StudyDate", "DA", "20240101"), el([model.PATIENT_ID], "PatientID", "LO", pid)]
        els += [el([model.ACCESSION_NUMBER], "AccessionNumber", "SH", acc)] if acc else []
        return header(f"r/f{i}.dcm", sorted(els, key=lambda e: e.pos))
    return frame(spark, [one(0, "P1", "A0"), one(1, "P1", None), one(2, "P2", "A2"), one(3, "P3", "A3")])


def patches(spark, rows, schema="patient_id string, new_accession string, new_patient_id string, new_study_date string"):
    return spark.createDataFrame(rows, schema)


def values(df, column="patched"):
    from incognita.functions.tags import top_value
    rows = df.select("path", *[top_value(column, t).alias(n) for n, t in (("pid", model.PATIENT_ID), ("acc", model.ACCESSION_NUMBER), ("day", model.STUDY_DATE))]).collect()
    return {r.path: (r.pid, r.acc, r.day) for r in rows}


def test_three_fields_and_files_without_a_patch(spark):
    h = files(spark)
    p = patches(spark, [("P1", "NEW", "", "20200202"), ("P2", None, "Q2", None), ("P9", "X", "X", "X"), (None, "X", "X", "X")])
    got = patch.apply_patches(h, p)
    assert set(h.columns) < set(got.columns) and got.count() == 4
    assert values(got) == {"r/f0.dcm": ("P1", "NEW", "20200202"), "r/f1.dcm": ("P1", "NEW", "20200202"), "r/f2.dcm": ("Q2", "A2", "20240101"), "r/f3.dcm": ("P3", "A3", "20240101")}
    assert {r.path for r in got.where("not has_patch").collect()} == {"r/f3.dcm"}


def test_by_path_keeps_the_path(spark):
    p = patches(spark, [("r/f2.dcm", "ONE")], "path string, new_accession string")
    got = patch.apply_patches(files(spark), p, key="path")
    assert values(got)["r/f2.dcm"][1] == "ONE" and values(got)["r/f0.dcm"][1] == "A0" and got.count() == 4
    with pytest.raises(patch.PatchError):
        patch.apply_patches(files(spark), p.withColumnRenamed("path", "nothing"), key="nothing")


def test_two_patches_for_a_key(spark):
    rows = [("P1", "FIRST", 1), ("P1", "LAST", 2), ("P2", "ONLY", 1)]
    p = patches(spark, rows, "patient_id string, new_accession string, at int")
    with pytest.raises(patch.PatchError, match="P1"):
        patch.apply_patches(files(spark), p)
    got = patch.apply_patches(files(spark), p, order="at")
    assert got.count() == 4 and values(got)["r/f0.dcm"][1] == "LAST"


def test_patch_columns_named_like_header_columns(spark):
    p = patches(spark, [("P1", "NEW", "wrong", "wrong")], "patient_id string, new_accession string, path string, study_date string")
    got = patch.apply_patches(files(spark), p)
    assert {r.path for r in got.collect()} == {f"r/f{i}.dcm" for i in range(4)}


def test_set_existing_returns_the_headers(spark):
    p = patches(spark, [("P1", "S1", True), ("P2", "S2", False), ("P9", "S9", True)], "patient_id string, new_value string, active boolean")
    got = patch.set_existing(files(spark), p, model.ACCESSION_NUMBER, active="active")
    assert {r.path: (r.status, r.value) for r in got.collect()} == {"r/f0.dcm": ("set", "S1"), "r/f1.dcm": ("absent", None), "r/f2.dcm": ("inactive", None), "r/f3.dcm": ("no_patch", None)}
    assert [v[1] for _, v in sorted(values(got).items())] == ["S1", None, "A2", "A3"]
    report = {(r.path, r.patient_id, r.status) for r in patch.set_report(files(spark), p, model.ACCESSION_NUMBER, active="active").collect()}
    assert (None, "P9", "no_file") in report and len(report) == 4


def test_edits_are_saved_with_fresh_keys(spark, scratch):
    p = patches(spark, [("P1", "NEW", "Q1", "20200202")])
    result = jobs.apply_edits(spark, files(spark), p, f"{scratch}/edited")
    assert result == {"n_files": 4, "n_edited": 2}
    back = {r.path: (r.patient_id, r.accession_number, r.study_date) for r in read_header_table(spark, f"{scratch}/edited").collect()}
    assert back["r/f0.dcm"] == ("Q1", "NEW", "20200202") and back["r/f3.dcm"] == ("P3", "A3", "20240101")
    jobs.set_tags(spark, read_header_table(spark, f"{scratch}/edited"), patches(spark, [("Q1", "SET")], "patient_id string, new_value string"),
                  model.ACCESSION_NUMBER, f"{scratch}/set")
    assert read_header_table(spark, f"{scratch}/set").where(F.col("accession_number") == "SET").count() == 2


def test_pixels_of_unequal_shapes(spark, scratch):
    from incognita.operators import pixels

    rows = [(1, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6], 2, 3, 3, 2), (2, [1, 2, 3, 4], [1, 2, 3, 4], 2, 2, 2, 2), (3, [1, 2], [1, 2, 3], 1, 2, 1, 3), (4, [], [7], 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, model.PIXEL_PAIRS)

    def cells(values, cols):
        return {divmod(i, max(cols, 1)): v for i, v in enumerate(values)}

    got = {}
    for r in pixels.pixel_diff(df).collect():
        got.setdefault(r.pair_id, set()).add((r.r, r.c, r.a, r.b))
    stats = {r.pair_id: (r.n_pixels, r.n_mismatch) for r in pixels.pixel_stats(df).collect()}
    for i, a, b, _, ac, _, bc in rows:
        x, y = cells(a, ac), cells(b, bc)
        want = {(*k, x.get(k), y.get(k)) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
        assert got.get(i, set()) == want and stats[i] == (len(x.keys() | y.keys()), len(want))
    df.write.parquet(f"{scratch}/pairs")
    assert jobs.compare_pixels(spark, f"{scratch}/pairs", f"{scratch}/cmp") == {"n_pairs": 4, "n_equal": 1, "n_mismatch": sum(len(v) for v in got.values())}
    assert spark.read.parquet(f"{scratch}/cmp/diff").count() == sum(len(v) for v in got.values())
