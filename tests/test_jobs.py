"""End-to-end jobs: create a registry, de-identify, rerun, re-identify, stream."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from incognita.operators import idpool, screen
from incognita.plans import jobs
from incognita.sources import fixtures as fx
from incognita.sources import registry as store
from incognita.streaming import incremental


def test_batch_job_commit_rerun_reidentify(spark, scratch):
    hdir = f"{scratch}/headers"
    fx.build_headers(spark, SF_SMALL).write.parquet(hdir)
    headers = spark.read.parquet(hdir)
    reg_root, out = f"{scratch}/registry", f"{scratch}/out"
    jobs.create_study(spark, reg_root, "Test study", "Dr PI", idpool.PoolRequest(n=450, secret="t"))
    r1 = jobs.deidentify(spark, headers, reg_root, out, run_id="r1")
    assert r1.registry_version == 2 and r1.new_studies > 0
    total = next(r for r in r1.report if r["is_total"])
    written = spark.read.parquet(f"{out}/headers")
    assert written.count() == total["n_anonymised"]
    # rerun: nothing new, same IDs, partitions replaced (not duplicated)
    ids1 = {r.path: r.study_id for r in written.select("path", "study_id").collect()}
    r2 = jobs.deidentify(spark, headers, reg_root, out, run_id="r1")
    assert r2.new_studies == 0 and r2.registry_version == 2
    written2 = spark.read.parquet(f"{out}/headers")
    assert written2.count() == len(ids1)
    assert {r.path: r.study_id for r in written2.select("path", "study_id").collect()} == ids1
    # re-identification through the registry gives back the original patient IDs
    back = jobs.reidentify(spark, out, reg_root)
    orig = {r.path: r.pid for r in headers.select(
        "path", F.get(F.filter("elements", lambda e: e["pos"][0] == 1048608), 0)["value"].alias("pid")).collect()}
    first_file_pid = {r.path: r.original_patient_id for r in back.collect()}
    assert len(first_file_pid) == len(ids1)
    assert all(first_file_pid[p] == orig[p] for p in first_file_pid)  # one patient per study in the fixture
    log = spark.read.parquet(f"{reg_root}/audit_log").orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, len(log) + 1))
    assert log[0].activity.startswith("New Study Created")


def test_stream_two_drops(spark, scratch):
    drop, reg_root, out = f"{scratch}/drop", f"{scratch}/registry", f"{scratch}/out"
    h = fx.build_headers(spark, SF_SMALL)
    jobs.create_study(spark, reg_root, "S", "P", idpool.PoolRequest(n=450, secret="t"))
    h.where(F.col("mtime") < "2024-01-16").write.parquet(f"{drop}/batch1")
    q = incremental.start(spark, drop, reg_root, out, checkpoint_location=f"{scratch}/ckpt")
    q.awaitTermination()
    v1 = store.load(spark, reg_root).version
    h.where(F.col("mtime") >= "2024-01-16").write.parquet(f"{drop}/batch2")
    q = incremental.start(spark, drop, reg_root, out, checkpoint_location=f"{scratch}/ckpt")
    q.awaitTermination()
    reg = store.load(spark, reg_root)
    assert reg.version > v1
    written = spark.read.parquet(f"{out}/headers")
    by_study = written.groupBy("study_id").agg(F.countDistinct("run_id").alias("runs"))
    assert by_study.count() > 0
    # a study spanning both drops keeps one ID
    per_uid = (written.select("path", "study_id")
               .join(h.select("path", screen.study_uid().alias("uid")), "path"))
    assert per_uid.groupBy("uid").agg(F.countDistinct("study_id").alias("n")).where("n > 1").count() == 0


def test_header_dump_job(spark, scratch):
    out = f"{scratch}/dump"
    jobs.header_dump(fx.headers(spark, SF_SMALL), out)
    d = spark.read.parquet(out)
    assert spark.read.parquet(f"{out}-failures").count() == fx.headers(spark, SF_SMALL).where("parse_error IS NOT NULL").count()
    assert d.count() == fx.headers(spark, SF_SMALL).where("parse_error IS NULL").count()
    row = d.first()
    assert row.out_path == row.path + ".hdr.txt"
    assert row.text.splitlines()[0].startswith("(0008,0020) Study Date  ")


def test_header_table_writer_derives_keys(spark, scratch):
    from incognita import model
    from incognita.sources.headers import read_header_table, write_header_table

    base = fx.build_headers(spark, SF_SMALL).drop(*model.KEY_COLUMNS)
    write_header_table(base, f"{scratch}/h")
    back = read_header_table(spark, f"{scratch}/h")
    assert back.columns == [f.name for f in model.HEADERS.fields]
    a = {r.path: r.study_uid for r in back.select("path", "study_uid").collect()}
    b = {r.path: r.study_uid for r in fx.build_headers(spark, SF_SMALL).select("path", "study_uid").collect()}
    assert a == b


def test_stream_many_micro_batches(spark, scratch):
    drop, reg_root, out = f"{scratch}/drop", f"{scratch}/registry", f"{scratch}/out"
    h = fx.build_headers(spark, SF_SMALL)
    jobs.create_study(spark, reg_root, "S", "P", idpool.PoolRequest(n=450, secret="t"))
    h.where(F.col("mtime") < "2024-01-16").coalesce(2).write.parquet(f"{drop}/a")
    h.where(F.col("mtime") >= "2024-01-16").coalesce(2).write.parquet(f"{drop}/b")
    q = incremental.start(spark, drop, reg_root, out, checkpoint_location=f"{scratch}/ckpt",
                          max_files_per_trigger=1)
    q.awaitTermination()
    written = spark.read.parquet(f"{out}/headers")
    assert written.select("run_id").distinct().count() == 4  # one micro-batch per file
    reg = store.load(spark, reg_root)
    assert reg.version >= 2
    per_uid = written.select("path", "study_id").join(h.select("path", screen.study_uid().alias("uid")), "path")
    assert per_uid.groupBy("uid").agg(F.countDistinct("study_id").alias("n")).where("n > 1").count() == 0
    assigned = reg.slots.where(F.col("patient_id").isNotNull()).count()
    assert assigned == written.select("study_id").distinct().count()


def test_a_failed_run_leaves_a_closing_line(spark, scratch):
    import pytest

    jobs.create_study(spark, f"{scratch}/reg", "t", "pi", idpool.PoolRequest(n=3, mask="d", secret="t"))
    bad = fx.headers(spark, SF_SMALL).withColumn("elements", F.raise_error(F.lit("broken table")).cast(fx.headers(spark, SF_SMALL).schema["elements"].dataType))
    with pytest.raises(Exception, match="broken table"):
        jobs.deidentify(spark, bad, f"{scratch}/reg", f"{scratch}/out", "r1")
    log = [r.activity for r in spark.read.parquet(f"{scratch}/reg/audit_log").orderBy("seq").collect()]
    assert log[-1].startswith("Run r1 failed") and not any("ompleted" in x for x in log)
