"""Skew and size-bound behaviour: a study with a third of all files, the shuffle fallback."""

import pytest
from pyspark.sql import functions as F

from helpers import el, frame, header
from incognita import model
from incognita.operators import idpool
from incognita.plans import deidentify as deid


def corpus(spark, n=600):
    rows = []
    for i in range(n):
        uid = "HOT" if i % 3 == 0 else f"S{i % 97}"
        rows.append(header(f"root{i % 2}/d{i % 7}/f{i:04d}.dcm",
                           [el([model.STUDY_DATE], "StudyDate", "DA", "20240101"),
                            el([model.PATIENT_NAME], "PatientName", "PN", f"N{i}"),
                            el([model.PATIENT_ID], "PatientID", "LO", f"P{i % 50}"),
                            el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", uid)],
                           root=f"root{i % 2}", root_ord=i % 2))
    return frame(spark, rows).repartition(6)


@pytest.fixture
def slots(spark):
    pool = idpool.generate(spark, idpool.PoolRequest(n=200, mask="uudddd", secret="x"))
    return idpool.empty_slots(pool)


def ids_by_path(run):
    return {r.path: r.study_id for r in run.output.select("path", "study_id").collect()}


def test_hot_study_gets_one_id_and_files_are_not_shuffled(spark, slots):
    run = deid.plan(corpus(spark), slots, {"n_study_ids": 200, "irb_code": "IRB"})
    out = run.output.select("path", "study_id")
    hot = out.join(run.files.where(F.col("study_uid") == "HOT").select("path"), "path")
    assert hot.count() == 200 and hot.select("study_id").distinct().count() == 1
    plan = run.output._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_shuffle_fallback_gives_the_same_result(spark, slots):
    headers = corpus(spark)
    front = {"n_study_ids": 200, "irb_code": "IRB"}
    expected = ids_by_path(deid.plan(headers, slots, front))
    old_budget = spark.conf.get("incognita.broadcast.maxBytes", None)
    old_auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("incognita.broadcast.maxBytes", "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        run = deid.plan(headers, slots, front)
        plan = run.output._jdf.queryExecution().executedPlan().toString()
        # the study map is shuffled (only the per-partition offsets table stays broadcast)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert ids_by_path(run) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_auto)
        if old_budget is None:
            spark.conf.unset("incognita.broadcast.maxBytes")
        else:
            spark.conf.set("incognita.broadcast.maxBytes", old_budget)


def test_bucketed_headers_are_joined_without_moving_them(spark, slots, scratch):
    """Past the broadcast budget: no Exchange above ``elements``; a third of the files in one study."""
    from incognita.sources.headers import write_bucketed_table

    front = {"n_study_ids": 200, "irb_code": "IRB"}
    expected = ids_by_path(deid.plan(corpus(spark), slots, front))
    headers = write_bucketed_table(corpus(spark), "bucketed_headers", 8, f"{scratch}/bucketed")
    old_auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("incognita.broadcast.maxBytes", "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        run = deid.plan(headers, slots, front)
        assert "HOT" in run.hot and len(run.hot) <= 200
        cold = headers.where("study_uid <> 'HOT'")
        joined = run.files.where(F.col("study_id").isNotNull())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        tree = plan.split("+- ")
        # whatever is exchanged is the study map or the assignment, never a scan with elements
        moved = [i for i, node in enumerate(tree) if node.startswith(("Exchange", "ShuffleQueryStage"))]
        for i in moved:
            depth = len("+- ".join(tree[:i]).splitlines()[-1])
            below = []
            for k in range(i + 1, len(tree)):
                if len("+- ".join(tree[:k]).splitlines()[-1]) <= depth:
                    break
                below.append(tree[k])
            assert not any("FileScan" in node and "elements" in node for node in below)
        assert "SortMergeJoin" in plan and cold.count() == 400
        assert ids_by_path(run) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_auto)
        spark.conf.unset("incognita.broadcast.maxBytes")
        spark.sql("DROP TABLE IF EXISTS bucketed_headers")


def test_volume_corpus_hot_study(spark):
    from conftest import SF_SMALL
    from incognita.sources import fixtures as fx

    vh = fx.build_volume_headers(spark, SF_SMALL)
    n = vh.select("study_uid").distinct().count()
    slots = idpool.empty_slots(idpool.generate(spark, idpool.PoolRequest(n=n, secret="v")))
    run = deid.plan(vh, slots, {"n_study_ids": n, "irb_code": "IRB"})
    assert run.output.count() == vh.count()  # every file de-identified, none exhausted
    per_study = run.files.groupBy("study_uid").agg(F.countDistinct("study_id").alias("ids"), F.count("*").alias("files"))
    assert per_study.where("ids <> 1").count() == 0
    hot = per_study.where(F.col("study_uid") == "2.25.0").first()
    assert hot.files >= vh.count() // 4  # about a third of all files
