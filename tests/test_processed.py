"""A rerun takes new and changed files only."""

from helpers import el, frame, header
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import idpool
from incognita.operators.scrub import DEFAULT_RULES
from incognita.plans import jobs
from incognita.sources import output, processed


def files(spark, names, times):
    rows = frame(spark, [header(f"r/{n}.dcm", [el([model.PATIENT_ID], "PatientID", "LO", f"P{n}"), el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", f"u{n}")], root="r")
                         for n in names])
    when = F.create_map(*[x for n, t in times.items() for x in (F.lit(f"r/{n}.dcm"), F.lit(t))])
    return rows.withColumn("mtime", when[F.col("path")].cast("timestamp"))


def test_todo_by_version_rules_and_last_run(spark):
    now = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", None), ("d", "2024-01-04"), ("e", "2024-01-05"), ("a", "2024-01-01")],
                                "path string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    done = spark.createDataFrame([("a", "2024-01-01", "R", "2024-02-01", "r1"), ("b", "2024-01-01", "R", "2024-02-01", "r1"), ("c", None, "R", "2024-02-01", "r1"),
                                  ("d", "2024-01-04", "other", "2024-02-01", "r1"), ("b", "2024-01-02", "R", "2024-02-02", "r2"), ("gone", None, "R", "2024-02-01", "r1")],
                                 "path string, mtime string, rules string, recorded_at string, run_id string")
    done = done.withColumn("mtime", F.col("mtime").cast("timestamp")).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    assert {tuple(r) for r in processed.todo(now, done, "R").collect()} == {("d", "changed"), ("e", "new")}
    assert {r.path for r in processed.todo(now, done.limit(0), "R").collect()} == {"a", "b", "c", "d", "e"}


def test_a_rerun_takes_new_and_changed_files(spark, scratch):
    reg, out = f"{scratch}/reg", f"{scratch}/out"
    jobs.create_study(spark, reg, "t", "pi", idpool.PoolRequest(n=3, mask="d", secret="t"))
    times = {"1": "2024-01-01", "2": "2024-01-01", "3": "2024-01-01"}
    jobs.deidentify(spark, files(spark, "12", times), reg, out, "r1", only_changed=True)
    times["2"] = "2024-01-02"
    jobs.deidentify(spark, files(spark, "1234", {**times, "4": "2024-01-01"}), reg, out, "r2", only_changed=True)
    by_run = {(r.path, r.run_id) for r in output.read(spark, out, current=False).collect()}
    assert by_run == {("r/1.dcm", "r1"), ("r/2.dcm", "r1"), ("r/2.dcm", "r2"), ("r/3.dcm", "r2")}  # 4 found no free ID
    done = processed.read(spark, out)
    assert {r.path for r in processed.todo(files(spark, "1234", {**times, "4": "2024-01-01"}), done, processed.rules_digest(DEFAULT_RULES)).collect()} == {"r/4.dcm"}
    # the same run again does its own files again, so that its partitions stay whole
    jobs.deidentify(spark, files(spark, "1234", {**times, "4": "2024-01-01"}), reg, out, "r2", only_changed=True)
    assert {(r.path, r.run_id) for r in output.read(spark, out, current=False).collect()} == by_run
