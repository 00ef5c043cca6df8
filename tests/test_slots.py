"""No two studies share a pseudonym, across runs, extensions and writers."""

import os

import pytest
from helpers import el, frame, header
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import idpool
from incognita.operators import registry_ops as reg
from incognita.plans import jobs
from incognita.sources import fixtures as fx
from incognita.sources import registry as store


def files(spark, uids):
    return frame(spark, [header(f"r/f{i:02d}.dcm", [el([model.PATIENT_ID], "PatientID", "LO", f"P-{u}"), el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", u)], root="r")
                         for i, u in enumerate(uids)])


def registry(spark, root, ids, n, used=()):
    rows = [(2 + i, s, "P" if 2 + i in used else None, f"old{i}" if 2 + i in used else None) for i, s in enumerate(ids)]
    slots = fx._as_slots(spark.createDataFrame(rows, "row_no bigint, study_id string, patient_id string, study_uid string"))
    return store.create(spark, root, "t", "pi", slots, n)


def owners(spark, root):
    return {r.study_id: r.study_uid for r in store.load(spark, root).slots.where("patient_id is not null").collect()}


def run(spark, scratch, uids, run_id):
    result = jobs.deidentify(spark, files(spark, uids), f"{scratch}/reg", f"{scratch}/out", run_id)
    return result, {r.path: r.study_id for r in spark.read.parquet(f"{scratch}/out/headers").where(F.col("run_id") == run_id).collect()}


def test_one_slot_past_the_pool_goes_to_one_study(spark, scratch):
    registry(spark, f"{scratch}/reg", ["A", "B", "C", "X"], 3)
    result, got = run(spark, scratch, [f"s{i}" for i in range(5)], "r1")
    assert sorted(got.values()) == ["A", "B", "C", "X"]
    total = next(r for r in result.report if r["is_total"])
    assert (total["n_anonymised"], total["n_exhausted"], result.new_studies, result.exhausted_studies) == (4, 1, 4, 1)
    before = owners(spark, f"{scratch}/reg")
    # the next run has no slot left: nobody's is given away
    result, got = run(spark, scratch, ["t0"], "r2")
    assert got == {} and result.exhausted_studies == 1
    assert owners(spark, f"{scratch}/reg") == before and len(set(before.values())) == 4
    assert any("past the declared pool size" in r.activity for r in spark.read.parquet(f"{scratch}/reg/audit_log").collect())


def test_extension_gives_each_study_its_own_id(spark, scratch):
    registry(spark, f"{scratch}/reg", ["A", "B", "C"], 3)
    run(spark, scratch, ["s0", "s1"], "r1")
    extended = jobs.extend_study(spark, f"{scratch}/reg", idpool.PoolRequest(n=2, mask="ud", secret="e"))
    assert extended.front["n_study_ids"] == 5 and extended.slots.count() == 5
    _, got = run(spark, scratch, ["s0", "s1", "s2", "s3", "s4"], "r2")
    assert len(set(got.values())) == 5
    _, again = run(spark, scratch, ["s5", "s0"], "r3")
    assert list(again.values()) == [got["r/f00.dcm"]]  # s5 finds none, s0 keeps its own
    own = owners(spark, f"{scratch}/reg")
    assert len(own) == 5 and len(set(own.values())) == 5


def test_used_and_free_slots_in_any_order(spark):
    rows = [(2, "A", "p", "u1"), (3, "B", None, None), (4, "", None, None), (5, "C", "p", "u2"), (6, "D", None, None), (7, None, None, None), (8, "E", None, None)]
    slots = fx._as_slots(spark.createDataFrame(rows, "row_no bigint, study_id string, patient_id string, study_uid string"))
    new = spark.createDataFrame([(f"n{i}", 0, f"r/f{i}") for i in range(4)], "study_uid string, root_ord int, path string")
    got = {r.study_uid: (r.row_no, r.study_id, r.over_pool) for r in reg.assign_slots(new, slots, reg.registry_stats(slots, 4)).collect()}
    assert got == {"n0": (3, "B", False), "n1": (6, "D", True), "n2": (8, "E", True), "n3": (None, None, False)}


def test_a_slot_in_use_is_never_overwritten(spark):
    slots = fx._as_slots(spark.createDataFrame([(2, "A", "p", "u1")], "row_no bigint, study_id string, patient_id string, study_uid string"))
    wrong = spark.createDataFrame([(2, "A", "p2", "u2")], "row_no bigint, study_id string, patient_id string, study_uid string")
    for c in model.SLOT_VALUE_COLUMNS:
        wrong = wrong if c in wrong.columns else wrong.withColumn(c, F.lit("x"))
    with pytest.raises(Exception, match="slot is in use"):
        reg.commit(slots, wrong).collect()


def test_empty_ids_are_refused_before_and_after(spark, scratch):
    registry(spark, f"{scratch}/reg", ["A", "", "C"], 3)
    with pytest.raises(store.RegistryError, match="without a study ID"):
        store.load(spark, f"{scratch}/reg")
    r = registry(spark, f"{scratch}/reg2", ["A", "B"], 2)
    folders = set(os.listdir(f"{scratch}/reg2/slots"))
    with pytest.raises(store.RegistryError, match="without a study ID"):
        store.commit(spark, r, r.slots.withColumn("study_id", F.when(F.col("row_no") == 3, "").otherwise(F.col("study_id"))))
    assert store.load(spark, f"{scratch}/reg2").version == 1 and set(os.listdir(f"{scratch}/reg2/slots")) == folders


def filled(r, row, uid):
    return r.slots.where(F.col("row_no") == row).withColumn("patient_id", F.lit("p")).withColumn("study_uid", F.lit(uid))


def test_two_writers_one_claim(spark, scratch):
    first = registry(spark, f"{scratch}/reg", ["A", "B"], 2)
    second = store.load(spark, f"{scratch}/reg")
    done = store.commit_changes(spark, first, filled(first, 2, "mine"))
    with pytest.raises(store.RegistryError, match="concurrent writer"):
        store.commit_changes(spark, second, filled(second, 2, "other"))
    now = store.load(spark, f"{scratch}/reg")
    assert now.version == done.version == 2
    assert owners(spark, f"{scratch}/reg") == {"A": "mine"} and now.slots.count() == 2


def test_dead_writers_leave_no_version(spark, scratch):
    r = registry(spark, f"{scratch}/reg", ["A", "B", "C"], 3)
    store._write_slots(f"{scratch}/reg", filled(r, 2, "lost"))  # died before the claim
    open(f"{scratch}/reg/commits/v{2:010d}", "w").close()  # died in the claim
    again = store.load(spark, f"{scratch}/reg")
    assert again.version == 1 and owners(spark, f"{scratch}/reg") == {}
    after = store.commit_changes(spark, again, filled(again, 2, "kept"))
    assert after.version == 3 and owners(spark, f"{scratch}/reg") == {"A": "kept"}


def test_changes_stack_and_are_written_in_full_again(spark, scratch, monkeypatch):
    monkeypatch.setattr(store, "SNAPSHOT_EVERY", 2)
    r = registry(spark, f"{scratch}/reg", list("ABCDEF"), 6)
    for i in range(5):
        r = store.commit_changes(spark, r, filled(r, 2 + i, f"s{i}"))
    assert r.version == 6 and len(r.changes) == 2
    assert owners(spark, f"{scratch}/reg") == {s: f"s{i}" for i, s in enumerate("ABCDE")}
    assert store.prune_versions(spark, f"{scratch}/reg", keep=1) == [1, 2, 3, 4, 5]
    assert store.load(spark, f"{scratch}/reg").slots.count() == 6
    assert len(os.listdir(f"{scratch}/reg/slots")) == 3
