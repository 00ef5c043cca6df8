"""Current versions of the output: replaced rows by position, reruns, lost claims, runs that died."""

import random

import pytest
from pyspark.sql import functions as F

from incognita.sources import manifest, output
from incognita.sources import registry as store


def put(spark, out, run_id, paths, roots=("007", "x y/z")):
    """Write a run's files without committing them."""
    rows = [(p, f"o/{p}", run_id, roots[i % len(roots)]) for i, p in enumerate(paths)]
    files = spark.createDataFrame(rows, "path string, out_path string, study_id string, root string").repartition(3)
    output.write(out, files.withColumn("elements", F.lit(None).cast(output.OUTPUT["elements"].dataType)), run_id)


def run(spark, out, run_id, paths, **kw):
    put(spark, out, run_id, paths, **kw)
    return output.commit(spark, out, run_id)


def held(spark, out):
    return sorted((str(r.path), r.run_id) for r in output.read(spark, out).collect())


def test_random_runs_and_reruns_against_a_dictionary(spark, scratch):
    rng, out, runs = random.Random(5), f"{scratch}/out", {}
    for i in range(9):
        run_id = f"r{i}" if i not in (4, 7) else "r1"  # r1 is run again twice
        paths = sorted(rng.sample([f"p{k}" for k in range(40)], rng.randint(3, 25)))
        run(spark, out, run_id, paths, roots=("one",))
        runs.pop(run_id, None)
        runs[run_id] = paths
        want = {p: r for r, ps in runs.items() for p in ps}
        assert held(spark, out) == sorted(want.items())
    assert output.read(spark, out, current=False).count() == sum(len(p) for p in runs.values())


def test_only_runs_with_current_rows_are_scanned_and_no_elements_move(spark, scratch):
    out = f"{scratch}/out"
    run(spark, out, "a", ["1", "2", "3"])
    plan = output.read(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    run(spark, out, "b", ["1", "2", "3"])
    version = manifest.newest(spark, out)
    assert version.live == ["b"] and held(spark, out) == [("1", "b"), ("2", "b"), ("3", "b")]
    run(spark, out, "c", ["2"])
    plan = output.read(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") and "SortMergeJoin" not in plan and "path#" not in plan.split("BroadcastExchange")[1]
    assert held(spark, out) == [("1", "b"), ("2", "c"), ("3", "b")]
    # a budget of nothing gives the same rows
    spark.conf.set("incognita.broadcast.maxBytes", "0")
    try:
        assert held(spark, out) == [("1", "b"), ("2", "c"), ("3", "b")]
        run(spark, out, "d", ["3"])
    finally:
        spark.conf.unset("incognita.broadcast.maxBytes")
    assert held(spark, out) == [("1", "b"), ("2", "c"), ("3", "d")]


def test_positions_past_one_bitmap(spark, scratch):
    out = f"{scratch}/out"
    rows = spark.range(0, 100_000, 1, 1).select(F.col("id").cast("string").alias("path"), F.lit("o").alias("out_path"), F.lit("s").alias("study_id"), F.lit("r").alias("root"))
    rows = rows.withColumn("elements", F.lit(None).cast(output.OUTPUT["elements"].dataType))
    output.write(out, rows, "a")
    output.commit(spark, out, "a")
    gone = [0, 7, 8, 32767, 32768, 65535, 65536, 99_999]
    version = run(spark, out, "b", [str(i) for i in gone])
    assert version.n_vectors == 4
    got = output.read(spark, out)
    assert got.count() == 100_000 and {int(r.path) for r in got.where("run_id = 'b'").collect()} == set(gone)
    assert got.select("path").distinct().count() == 100_000


def test_repeated_and_missing_paths_and_empty_runs(spark, scratch):
    out = f"{scratch}/out"
    assert output.commit(spark, out, "none") is None
    run(spark, out, "a", ["1", "1", None, "2"])
    run(spark, out, "b", [None, "1"])
    assert held(spark, out) == [("1", "b"), ("2", "a"), ("None", "a"), ("None", "b")]
    before = held(spark, out)
    output.commit(spark, out, "empty")  # a run that wrote no file
    assert held(spark, out) == before


def test_a_run_that_died_is_not_read_and_its_rerun_is(spark, scratch):
    out = f"{scratch}/out"
    run(spark, out, "a", ["1", "2"])
    put(spark, out, "b", ["2", "3"])
    assert held(spark, out) == [("1", "a"), ("2", "a")]
    run(spark, out, "b", ["2", "3"])
    assert held(spark, out) == [("1", "a"), ("2", "b"), ("3", "b")]
    put(spark, out, "b", ["3"])  # its rerun no longer makes 2: the earlier version is current again
    assert len(output.remove_stale(spark, out, "b", ["007"])) == 1
    output.commit(spark, out, "b")
    assert held(spark, out) == [("1", "a"), ("2", "a"), ("3", "b")]


def test_the_second_of_two_writers_starts_over(spark, scratch, monkeypatch):
    out = f"{scratch}/out"
    run(spark, out, "a", ["1", "2"])
    put(spark, out, "b", ["1"])
    put(spark, out, "c", ["1"])
    real, raced = store._create_new, []

    def late(s, path, text):
        if not raced:
            raced.append(path)
            monkeypatch.setattr(store, "_create_new", real)
            output.commit(s, out, "b")  # the other writer is first
        return real(s, path, text)

    monkeypatch.setattr(store, "_create_new", late)
    output.commit(spark, out, "c")
    assert held(spark, out) == [("1", "c"), ("2", "a")] and manifest.newest(spark, out).number == 3


def test_tables_without_commit_files_and_pruning(spark, scratch):
    out = f"{scratch}/out"
    put(spark, out, "a", ["1", "2"])
    put(spark, out, "b", ["2"])
    run(spark, out, "c", ["3"])
    want = [("1", "a"), ("2", "b"), ("3", "c")]
    assert held(spark, out) == want
    run(spark, out, "d", ["4"])
    assert manifest.prune(spark, out, keep=1) == [1] and held(spark, out) == [*want, ("4", "d")]
    with pytest.raises(ValueError):
        manifest.prune(spark, out, keep=0)
