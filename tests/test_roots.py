"""From raw folders to outcomes; output versions; stream restarts; nothing of a patient in scratch folders."""

import os
import subprocess
import sys

import pytest
from helpers import el, frame, header
from pyspark.sql import functions as F
from test_files import write

from incognita import model
from incognita.operators import idpool
from incognita.plans import jobs
from incognita.sources import files as raw
from incognita.sources import output
from incognita.sources.headers import write_header_table
from incognita.streaming import incremental

DICOM = b"\0" * 128 + b"DICM" + b"\0" * 400


def parsed(spark, rows):
    return frame(spark, [header(p, [el([model.PATIENT_NAME], "PatientName", "PN", f"SECRETNAME^{i}"), el([model.PATIENT_ID], "PatientID", "LO", f"SECRETID{i}"),
                                    el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", uid)], root=r, root_ord=0) for i, (p, r, uid) in enumerate(rows)])


def study(spark, scratch, n=20):
    jobs.create_study(spark, f"{scratch}/reg", "t", "pi", idpool.PoolRequest(n=n, secret="s"))
    return f"{scratch}/reg"


def test_raw_roots_to_report(spark, scratch):
    root = f"{scratch}/007"
    write(f"{root}/a/x.dcm", DICOM)
    write(f"{root}/a/y.dcm", DICOM)
    write(f"{root}/a/DICOMDIR", DICOM)
    write(f"{root}/b/note.txt", b"x" * 200)
    write(f"{root}/b/short", b"x")
    write(f"{root}/b/broken.dcm", DICOM)  # a candidate that the parser could not read
    reg = study(spark, scratch)
    h = parsed(spark, [(f"{root}/a/x.dcm", root, "u1"), (f"{root}/a/y.dcm", root, "u1"), (f"{root}/a/DICOMDIR", root, "u1")])
    result = jobs.deidentify_roots(spark, [root], h, reg, f"{scratch}/out", "r1")
    total = next(r for r in result.report if r["is_total"])
    assert (total["n_files"], total["n_dirs"], total["n_anonymised"], total["n_skipped"], total["n_non_dicom"]) == (6, 2, 2, 1, 3)
    got = {os.path.basename(r.path): r.message for r in output.read_outcomes(spark, f"{scratch}/out").collect()}
    assert got["DICOMDIR"] == "DICOMDIR" and got["note.txt"].endswith("fourcc failed- non-dicom") and got["broken.dcm"].endswith("load failed- non-dicom")
    assert any(root in r.activity for r in spark.read.parquet(f"{reg}/audit_log").collect())


def test_relative_roots_and_strangers(spark, scratch, monkeypatch):
    write(f"{scratch}/data/a/x.dcm", DICOM)
    name = os.path.relpath(f"{scratch}/data")
    row = raw.with_magic(spark, [name]).first()
    assert row.path == f"{scratch}/data/a/x.dcm" and row.root == f"{scratch}/data" and row.magic == "DICM"
    with pytest.raises(Exception, match="under no root"):
        spark.range(1).select(raw.root_of(F.lit("file:/elsewhere/x"), ["file:/here"])[0]).collect()


def test_only_the_head_of_candidates_is_read(spark, scratch):
    write(f"{scratch}/r/x.dcm", DICOM)
    df = raw.with_magic(spark, [f"{scratch}/r"])
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_output_keeps_text_roots_and_one_version_of_a_file(spark, scratch):
    reg, out = study(spark, scratch), f"{scratch}/out"
    rows = [("007/a.dcm", "007", "u1"), ("007/b.dcm", "007", "u2"), ("x/c.dcm", "x", "u3")]
    jobs.deidentify(spark, parsed(spark, rows), reg, out, "001")
    jobs.deidentify(spark, parsed(spark, rows), reg, out, "002")
    both = output.read(spark, out, current=False)
    assert both.count() == 6 and {r.root for r in both.collect()} == {"007", "x"} and {r.run_id for r in both.collect()} == {"001", "002"}
    assert {(r.path, r.run_id) for r in output.read(spark, out).collect()} == {(p, "002") for p, _, _ in rows}
    assert jobs.reidentify(spark, out, reg).count() == 3
    # a rerun without root x removes what it made for x
    jobs.deidentify(spark, parsed(spark, rows[:2]), reg, out, "002")
    assert {r.path for r in output.read(spark, out, current=False).where("run_id = '002'").collect()} == {"007/a.dcm", "007/b.dcm"}


def test_null_root_and_total_are_told_apart(spark):
    from incognita.plans.deidentify import run_report

    rows = [("a/x", None, "ok"), ("b/y", "r", "ok")]
    got = run_report(spark.createDataFrame(rows, "path string, root string, outcome string")).collect()
    assert sorted((str(r.root), r.is_total, r.n_files) for r in got) == [("None", False, 1), ("None", True, 2), ("r", False, 1)]


def test_files_without_key_columns_get_them(spark, scratch):
    reg = study(spark, scratch)
    parsed(spark, [("r/a.dcm", "r", "u1"), ("r/b.dcm", "r", "u2")]).drop(*model.KEY_COLUMNS).write.parquet(f"{scratch}/drop/one")
    with pytest.raises(TypeError):
        incremental.start(spark, f"{scratch}/drop", reg, f"{scratch}/out")
    q = incremental.start(spark, f"{scratch}/drop", reg, f"{scratch}/out", f"{scratch}/ckpt")
    q.awaitTermination()
    assert output.read(spark, f"{scratch}/out").count() == 2


def test_two_streams_and_a_restart_never_replace_batches(spark, scratch):
    reg = study(spark, scratch)
    for i, uid in enumerate(["u1", "u2"]):
        write_header_table(parsed(spark, [(f"r/{uid}.dcm", "r", uid)]), f"{scratch}/drop{i}/one")
        incremental.start(spark, f"{scratch}/drop{i}", reg, f"{scratch}/out", f"{scratch}/ckpt{i}").awaitTermination()
    write_header_table(parsed(spark, [("r/u3.dcm", "r", "u3")]), f"{scratch}/drop0/two")
    incremental.start(spark, f"{scratch}/drop0", reg, f"{scratch}/out", f"{scratch}/ckpt0").awaitTermination()
    rows = output.read(spark, f"{scratch}/out", current=False).collect()
    assert sorted(r.path for r in rows) == ["r/u1.dcm", "r/u2.dcm", "r/u3.dcm"]
    assert len({r.run_id for r in rows}) == 3 and len({r.study_id for r in rows}) == 3


SCRATCH = """
import glob, os, sys
sys.path[:0] = [{repo!r}, {repo!r} + "/tests"]
from pyspark.sql import SparkSession
from incognita.session import LOCAL_CONF, ensure_checkpoint_dir
b = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
for k, v in LOCAL_CONF.items():
    b = b.config(k, v)
spark = b.getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from test_roots import parsed, study, jobs
folder = ensure_checkpoint_dir(spark).removeprefix("file:")
reg = study(spark, {scratch!r})
jobs.deidentify(spark, parsed(spark, [("r/a.dcm", "r", "u1"), ("r/b.dcm", "r", "u2")]), reg, {scratch!r} + "/out", "r1")
found = [f for f in glob.glob(folder + "/**", recursive=True) if os.path.isfile(f)]
print("FILES", len(found), "SECRET", sum(b"SECRET" in open(f, "rb").read() for f in found), folder)
"""


def test_nothing_of_a_patient_in_checkpoints_and_no_folder_left(scratch):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRATCH.format(repo=repo, scratch=scratch)], capture_output=True, text=True, timeout=300)
    line = next(x for x in done.stdout.splitlines() if x.startswith("FILES"))
    _, n, _, secret, folder = line.split()
    assert int(n) > 0 and int(secret) == 0, done.stderr[-2000:]
    if "incognita-ckpt-" in folder:  # our own folder, not one that the session names
        assert not os.path.exists(folder)


def test_creation_warnings(spark, scratch):
    from incognita.sources import registry as store

    jobs.create_study(spark, f"{scratch}/reg", "t", "pi", idpool.PoolRequest(n=10, mask="d", prefix="A-LONG-PREFIX-", suffix="-END", secret="s"))
    log = [r.activity for r in spark.read.parquet(f"{scratch}/reg/audit_log").collect()]
    assert sum(x.startswith("Warning") for x in log) == 2
    assert store.study_folder("/x/", "my study.v2") == "/x/my_studyv2"
