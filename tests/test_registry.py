"""Registry properties on the sf0.001 fixture and on hand-built slot tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from incognita.operators import registry_ops as reg
from incognita.plans import deidentify as deid
from incognita.sources import fixtures as fx
from incognita.sources import registry as store


@pytest.fixture(scope="module")
def run(spark):
    front = fx.study_front(spark, SF_SMALL).first().asDict()
    return deid.plan(fx.headers(spark, SF_SMALL), fx.pool(spark, SF_SMALL), front), front


def test_one_id_per_study_and_no_sharing(run):
    r, _ = run
    files = r.files.where(F.col("study_id").isNotNull())
    assert files.groupBy("study_uid").agg(F.countDistinct("study_id").alias("n")).where("n > 1").count() == 0
    assert files.groupBy("study_id").agg(F.countDistinct("study_uid").alias("n")).where("n > 1").count() == 0


def test_new_studies_take_consecutive_free_slots(run):
    r, _ = run
    a = r.assignments.orderBy("k").collect()
    assert [x.k for x in a] == list(range(1, len(a) + 1))
    # slots run out at sf0.001: exactly the studies past the last slot get none
    last = r.stats.max_row
    assert [x.row_no for x in a] == [n if n <= last else None for n in range(r.stats.first_free, r.stats.first_free + len(a))]
    assert all((x.study_id is None) == (x.row_no is None) for x in a)
    assert any(x.study_id is not None for x in a)


def test_rerun_after_commit_assigns_nothing(spark, run):
    r, front = run
    committed = reg.commit(fx.pool(spark, SF_SMALL), r.assignments).checkpoint()
    again = deid.plan(fx.headers(spark, SF_SMALL), committed, front)
    assert again.assignments.where(F.col("study_id").isNotNull()).count() == 0  # exhausted stay exhausted
    before = {x.path: x.study_id for x in r.output.select("path", "study_id").collect()}
    after = {x.path: x.study_id for x in again.output.select("path", "study_id").collect()}
    assert before == after


def slots_frame(spark, rows):
    return fx._as_slots(spark.createDataFrame(rows, "row_no bigint, study_id string, patient_id string, study_uid string"))


def test_exhausted_and_over_pool(spark):
    slots = slots_frame(spark, [(2, "A1", "p", "u1"), (3, "A2", None, None), (4, "A3", None, None),
                                (5, "EXTRA", None, None)])  # n = 3, row 5 lies past the pool
    stats = reg.registry_stats(slots, 3)
    assert stats.first_free == 3
    new = spark.createDataFrame([(f"n{i}", 0, f"r/f{i}") for i in range(5)], "study_uid string, root_ord int, path string")
    got = {x.study_uid: (x.row_no, x.study_id, x.over_pool) for x in reg.assign_slots(new, slots, stats).collect()}
    assert got["n0"] == (3, "A2", False) and got["n1"] == (4, "A3", False)
    assert got["n2"] == (5, "EXTRA", True)  # non-empty ID past n: used, flagged
    assert got["n3"][1] is None and got["n4"][1] is None  # exhausted


def test_registry_index_last_wins(spark):
    idx = reg.registry_index(fx.pool_dup(spark, SF_SMALL))
    row = idx.where(F.col("study_uid") == "1.2.0.20240110").first()
    assert (row.row_no, row.study_id) == (11, "AH1284")


def test_check_reports_gap_and_load_refuses(spark, scratch):
    n = fx.study_front(spark, SF_SMALL).first().n_study_ids
    checks = {r.check: r.value for r in store.check_slots(fx.pool_gap(spark, SF_SMALL), n).collect()}
    assert checks["first_gap_row"] == 100
    assert store.problems_of(store.check_slots(fx.pool_gap(spark, SF_SMALL), n))
    assert not store.problems_of(store.check_slots(fx.pool(spark, SF_SMALL), n))
    store.create(spark, scratch + "/reg", "t", "pi", fx.pool_gap(spark, SF_SMALL), n)
    with pytest.raises(store.RegistryError, match="gap at row 100"):
        store.load(spark, scratch + "/reg")


def test_missing_parts_are_all_listed(spark, scratch):
    with pytest.raises(store.RegistryError) as e:
        store.load(spark, scratch + "/nothing")
    msg = str(e.value)
    assert "'study'" in msg and "'slots'" in msg and "'audit_log'" in msg


def test_versions_are_never_overwritten(spark, scratch):
    n = fx.study_front(spark, SF_SMALL).first().n_study_ids
    r1 = store.create(spark, scratch + "/reg", "t", "pi", fx.pool(spark, SF_SMALL), n)
    r2 = store.commit(spark, r1, r1.slots)
    assert r2.version == 2
    with pytest.raises(store.RegistryError, match="concurrent writer"):
        store.commit(spark, r1, r1.slots)  # r1 is stale: version 2 exists


def test_first_free_slot_full_registry(spark):
    slots = slots_frame(spark, [(2, "A", "p", "u"), (3, "B", "p", "v")])
    assert reg.first_free_slot(slots, 2).first()[0] == 4


def test_prune_keeps_latest_versions(spark, scratch):
    n = fx.study_front(spark, SF_SMALL).first().n_study_ids
    r = store.create(spark, scratch + "/reg", "t", "pi", fx.pool(spark, SF_SMALL), n)
    for _ in range(3):
        r = store.commit(spark, r, r.slots)
    assert r.version == 4
    assert store.prune_versions(spark, scratch + "/reg", keep=2) == [1, 2]
    again = store.load(spark, scratch + "/reg")
    assert again.version == 4 and again.slots.count() == r.slots.count()
    with pytest.raises(ValueError):
        store.prune_versions(spark, scratch + "/reg", keep=0)


def test_log_numbers_are_claimed_once(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    root = f"{scratch}/reg"
    with ThreadPoolExecutor(6) as pool:
        firsts = list(pool.map(lambda i: (store.reserve(spark, root, 1 + i % 3), 1 + i % 3), range(24)))
    taken = sorted(x for first, n in firsts for x in range(first, first + n))
    assert taken == list(range(1, len(taken) + 1))
    # a claim whose writer died before it wrote its length is passed over
    open(f"{root}/sequence/s{taken[-1] + 1:020d}", "w").close()
    assert store.reserve(spark, root, 2) == taken[-1] + 1 + store.LOST_CLAIM


def test_numbers_go_on_behind_an_old_log_and_the_log_is_not_scanned_again(spark, scratch, monkeypatch):
    root = f"{scratch}/reg"
    rows = spark.createDataFrame([(7, 1, "old")], "seq bigint, level int, activity string").selectExpr("seq", "current_timestamp() ts", "level", "activity", "'' user", "'' computer")
    store.append_log_frame(root, rows)
    store.append_log(spark, root, [(1, "a"), (1, "b")])
    monkeypatch.setattr(store, "last_seq", None)
    store.append_log(spark, root, [(1, "c")])
    assert [(r.seq, r.activity) for r in spark.read.parquet(f"{root}/audit_log").orderBy("seq").collect()] == [(7, "old"), (8, "a"), (9, "b"), (10, "c")]
