"""Registry in hash buckets: equal to the plain one, and reading only what a batch touches."""

import os
import random

import numpy as np
import pytest
from helpers import el, frame, header
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import idpool
from incognita.plans import jobs
from incognita.sources import buckets
from incognita.sources import fixtures as fx
from incognita.sources import registry as store


def files(spark, uids):
    return frame(spark, [header(f"r/f{i:04d}.dcm", [el([model.PATIENT_ID], "PatientID", "LO", f"P-{u}"), el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", u)], root="r")
                         for i, u in enumerate(uids)])


def slots(spark, n, used=()):
    rows = [(2 + i, f"ID{i:06d}", "P" if 2 + i in used else None, f"old{2 + i}" if 2 + i in used else None) for i in range(n)]
    return fx._as_slots(spark.createDataFrame(rows, "row_no bigint, study_id string, patient_id string, study_uid string"))


def assigned(spark, pairs):
    return fx._as_slots(spark.createDataFrame([(r, i, f"P-{u}", u) for u, r, i in pairs], "row_no bigint, study_id string, patient_id string, study_uid string"))


@given(st.lists(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=300), st.lists(st.integers(-2**63, 2**63 - 1), max_size=50))
@settings(max_examples=60, deadline=None)
def test_bloom_filter_misses_no_key(keys, others):
    held = buckets.bloom(np.array(keys, np.int64))
    assert all(buckets.may_hold(held, np.array([k], np.int64)) for k in keys)
    assert not buckets.may_hold(held, np.zeros(0, np.int64))
    wrong = sum(buckets.may_hold(held, np.array([k], np.int64)) for k in others if k not in keys)
    assert wrong <= max(5, len(others) // 5)


def test_runs_equal_those_on_a_slot_table(spark, scratch):
    n = 60
    with pytest.raises(store.RegistryError):  # a gap (5, 6)
        buckets.create(spark, f"{scratch}/b0", "t", "pi", slots(spark, n, (2, 3, 4, 7)), n)
    pool = slots(spark, n, (2, 3, 4))
    store.create(spark, f"{scratch}/plain", "t", "pi", pool, n)
    buckets.create(spark, f"{scratch}/reg", "t", "pi", pool, n, buckets=4, segment_rows=16)
    rng = random.Random(3)
    for run, uids in enumerate((["a", "b", "old2", "a"], ["c", "old3", "b"] + [f"s{rng.randint(0, 90)}" for _ in range(90)])):
        got = {}
        for root in ("plain", "reg"):
            r = jobs.deidentify(spark, files(spark, uids), f"{scratch}/{root}", f"{scratch}/out-{root}", f"r{run}")
            rows = spark.read.parquet(f"{scratch}/out-{root}/headers").where(F.col("run_id") == f"r{run}").select("path", "study_id").collect()
            got[root] = ({x.path: x.study_id for x in rows}, r.new_studies, r.exhausted_studies, r.registry_version)
        assert got["plain"] == got["reg"]
    keep = ["row_no", "study_id", "patient_id", "study_uid"]
    plain, ours = (sorted(map(tuple, s.select(*keep).collect())) for s in (store.load(spark, f"{scratch}/plain").slots, buckets.load(spark, f"{scratch}/reg").slots()))
    assert plain == ours
    log = spark.read.parquet(f"{scratch}/reg/audit_log").orderBy("seq").collect()
    assert len({r.seq for r in log}) == len(log)
    ids = spark.createDataFrame([("ID000000",), ("ID000003",), ("nobody",)], "study_id string")
    back = {r.study_id: (r.original_patient_id, r.original_study_uid) for r in jobs.reidentify_ids(spark, ids, f"{scratch}/reg").collect()}
    assert back == {"ID000000": ("P", "old2"), "ID000003": ("P-a", "a")}
    whole = {r.study_id for r in jobs.reidentify(spark, f"{scratch}/out-reg", f"{scratch}/reg").collect()}
    assert whole == {r.study_id for r in jobs.reidentify(spark, f"{scratch}/out-plain", f"{scratch}/plain").collect()}


def test_a_batch_reads_what_its_studies_touch(spark, scratch, monkeypatch):
    monkeypatch.setattr(buckets, "FANOUT", 3)
    n, commits = 3000, 7
    r = buckets.create(spark, f"{scratch}/reg", "t", "pi", slots(spark, n, range(2, 1002)), n, buckets=16, segment_rows=100)
    row = 1002
    for c in range(commits):
        r = r.commit(assigned(spark, [(f"c{c}-{i}", row + i, f"ID{row + i - 2:06d}") for i in range(10)]))
        row += 10
    per_bucket = [len(es) for es in r.content["tables"]["by_uid"].values()]
    assert max(per_bucket) <= 2 * buckets.FANOUT  # merged, though each bucket got a file from most of the commits
    total = sum(per_bucket)
    for uid, want in (("c3-4", 1002 + 34), ("old77", 77), ("nobody", None)):
        got = r.known(spark.createDataFrame([(uid,)], "study_uid string")).collect()
        assert [x.row_no for x in got] == ([want] if want else [])
        assert r.files_read <= 2 < total
    assert r.known(spark.createDataFrame([(None,)], "study_uid string")).count() == 0
    everything = spark.createDataFrame([(f"c{c}-{i}",) for c in range(commits) for i in range(10)], "study_uid string")
    assert r.known(everything).count() == commits * 10
    assert r.stats().n_assigned == 1000 + 10 * commits and r.content["cursor"] == row
    free = r.free(250).orderBy("k").collect()
    assert [x.row_no for x in free] == list(range(row, row + 250)) and [x.k for x in free] == list(range(1, 251))
    assert r.free(10**6).count() == n + 2 - row


def test_extension_and_exhaustion(spark, scratch):
    jobs.create_study(spark, f"{scratch}/reg", "t", "pi", idpool.PoolRequest(n=3, mask="dd", secret="x"), bucketed=True)
    r1 = jobs.deidentify(spark, files(spark, ["a", "b", "c", "d"]), f"{scratch}/reg", f"{scratch}/out", "r1")
    assert (r1.new_studies, r1.exhausted_studies) == (3, 1)
    jobs.extend_study(spark, f"{scratch}/reg", idpool.PoolRequest(n=2, mask="dd", secret="y"))
    r2 = jobs.deidentify(spark, files(spark, ["a", "d", "e", "f"]), f"{scratch}/reg", f"{scratch}/out", "r2")
    assert (r2.new_studies, r2.exhausted_studies) == (2, 1)
    own = buckets.load(spark, f"{scratch}/reg").slots().where("patient_id is not null")
    assert own.count() == own.select("study_id").distinct().count() == own.select("study_uid").distinct().count() == 5


def test_what_may_not_be_committed(spark, scratch):
    r = buckets.create(spark, f"{scratch}/reg", "t", "pi", slots(spark, 20, (2, 3)), 20, buckets=4, segment_rows=8)
    bad = {"row in use": [("x", 3, "ID000001")], "wrong ID": [("x", 5, "ID000009")], "known study": [("old2", 4, "ID000002")],
           "study twice": [("x", 4, "ID000002"), ("x", 5, "ID000003")], "row twice": [("x", 4, "ID000002"), ("y", 4, "ID000002")], "no such row": [("x", 99, "ID000097")]}
    for pairs in bad.values():
        with pytest.raises(store.RegistryError, match="failed checks"):
            r.commit(assigned(spark, pairs))
    assert buckets.load(spark, f"{scratch}/reg").version == 1
    first, second = r.commit(assigned(spark, [("x", 4, "ID000002")])), None
    with pytest.raises(store.RegistryError, match="concurrent writer"):
        second = r.commit(assigned(spark, [("y", 4, "ID000002")]))
    assert second is None and first.version == 2
    now = buckets.load(spark, f"{scratch}/reg")
    assert {x.study_uid for x in now.slots().where("patient_id is not null").collect()} == {"old2", "old3", "x"}
    assert now.known(spark.createDataFrame([("y",)], "study_uid string")).count() == 0


def test_empty_batch(spark, scratch):
    buckets.create(spark, f"{scratch}/reg", "t", "pi", slots(spark, 5), 5)
    r = jobs.deidentify(spark, files(spark, ["a"]).limit(0), f"{scratch}/reg", f"{scratch}/out", "r0")
    assert r.new_studies == 0 and r.registry_version == 1


def test_pruning_keeps_what_the_newest_version_reads(spark, scratch, monkeypatch):
    monkeypatch.setattr(buckets, "FANOUT", 2)
    r = buckets.create(spark, f"{scratch}/reg", "t", "pi", slots(spark, 20, (2,)), 20, buckets=1, segment_rows=8)
    for i in range(3):
        r = r.commit(assigned(spark, [(f"u{i}", 3 + i, f"ID{1 + i:06d}")]))
    before = set(os.listdir(f"{scratch}/reg/index/by_uid"))
    assert buckets.prune(spark, f"{scratch}/reg", keep=1) == [1, 2, 3]
    after = set(os.listdir(f"{scratch}/reg/index/by_uid"))
    assert after < before and store.versions(spark, f"{scratch}/reg") == [4]
    now = buckets.load(spark, f"{scratch}/reg")
    keys = spark.createDataFrame([("u0",), ("u1",), ("u2",), ("old2",)], "study_uid string")
    assert {x.study_uid: x.row_no for x in now.known(keys).collect()} == {"u0": 3, "u1": 4, "u2": 5, "old2": 2}
    assert now.commit(assigned(spark, [("u3", 6, "ID000004")])).version == 5
    with pytest.raises(ValueError):
        buckets.prune(spark, f"{scratch}/reg", keep=0)
