"""What must not grow with the input: files on disk, partitions of a listing, rows sorted by a writer, arrays made anew."""

import datetime
import json
import os

import numpy as np
from pyspark.sql import functions as F

from incognita.functions.tags import with_keys
from incognita.llm import lm_score
from incognita.operators import screen
from incognita.plans import catalog
from incognita.sources import fixtures as fx
from incognita.sources import listing, manifest, output

LAMBDA = "lambdafunction"


def events(spark, scratch, n=60):
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 28, i % 24), None if i == 5 else 1 if i % 2 else i % 9, ["view", "click"][i % 2], 1.0, '{"a": 1}')
            for i in [*range(n), 193, 203, 251]]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{scratch}/events.parquet")
    return scratch


def below(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names]


def test_trees_lie_on_disk_one_at_a_time(spark, scratch):
    sf, seen, last = events(spark, scratch), [], None
    for roots in fx.trees(spark, sf, files=20):
        if last:
            assert not os.path.exists(last)
        last = os.path.dirname(roots[0])
        seen.append([os.path.relpath(f, last) for f in below(last)])
    assert not os.path.exists(last)
    assert len(seen) >= 3 and max(map(len, seen)) < 50
    every = [f for tree in seen for f in tree]
    assert len(every) == 62 and len(set(every)) == 62


def test_scan_tree_is_the_same_from_many_trees(spark, scratch, monkeypatch):
    sf = events(spark, scratch)
    one = sorted(map(tuple, catalog.q_scan_tree(spark, sf).collect()))
    monkeypatch.setattr(fx.trees, "__defaults__", (20,))
    assert sorted(map(tuple, catalog.q_scan_tree(spark, sf).collect())) == one and sum(r[1] for r in one) == 62


def test_folders_are_dealt_to_a_bounded_number_of_partitions(scratch):
    for i in range(90):
        os.makedirs(f"{scratch}/{'a' if i < 60 else 'b'}/p{i}/s")
        with open(f"{scratch}/{'a' if i < 60 else 'b'}/p{i}/s/f", "wb") as f:
            f.write(b"x")
    reader = listing.FolderReader({"roots": json.dumps([f"{scratch}/a", f"{scratch}/b"]), "partitions": "8"})
    parts = reader.partitions()
    assert len(parts) <= 12 and sum(len(p.folders) for p in parts if p.deep) == 90
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 90


def test_writer_keeps_roots_open_and_leaves_the_setting(spark, scratch, monkeypatch):
    key, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    write = output._write
    monkeypatch.setattr(output, "_write", lambda *a: (seen.append(spark.conf.get(key)), write(*a)))
    before = spark.conf.get(key)
    files = fx.derived_headers(spark, events(spark, scratch)).select("path", F.col("path").alias("out_path"), F.col("study_uid").alias("study_id"), "elements", "root")
    for run_id in ("r1", "r2"):
        output.write(f"{scratch}/out", files, run_id)
        output.commit(spark, f"{scratch}/out", run_id)
    assert int(seen[0]) >= 8 and spark.conf.get(key) == before
    assert {(r.run_id, r.path) for r in output.read(spark, f"{scratch}/out").collect()} >= {("r2", r.path) for r in files.where("path is not null").collect()}


def test_first_commit_joins_nothing(spark, scratch, monkeypatch):
    files = fx.derived_headers(spark, events(spark, scratch)).select("path", F.col("path").alias("out_path"), F.col("study_uid").alias("study_id"), "elements", "root")
    output.write(f"{scratch}/out", files, "r1")
    monkeypatch.setattr(manifest, "_replaced", None)
    assert output.commit(spark, f"{scratch}/out", "r1").vectors is None


def test_headers_are_compiled_and_pruned(spark, scratch):
    h = fx.derived_headers(spark, events(spark, scratch))
    again = with_keys(h.select("path", "root", "root_ord", "mtime", "magic", "parse_error", "elements"))
    assert again.columns == h.columns
    assert h.exceptAll(again).count() == 0 and again.exceptAll(h).count() == 0
    assert {r.study_uid for r in h.collect() if r.path and "/e203/" in r.path} == {"9.9.1"}  # a nested UID comes first
    assert LAMBDA not in h._jdf.queryExecution().executedPlan().toString()
    keys = screen.classify(h).select("path", "study_uid", "outcome")._jdf.queryExecution().optimizedPlan().toString()
    assert "CurveData" not in keys


def test_file_name_is_what_the_pattern_gave(spark):
    names = ["a/b", "a\\b", "b", "", None, "a/", "a\\", "a/b\n", "a/\n", "\n", "x/y\\z/é.dcm", "a/b\r\n", "a\nb/c"]
    df = spark.createDataFrame([(v,) for v in names], "p string").select(screen.file_name("p").alias("n"), F.regexp_extract("p", r"([^/\\]*)$", 1).alias("want"))
    assert df.where("not n <=> want").count() == 0
    assert "rlike" not in str(screen.file_name("p")) and "regexp" not in str(screen.file_name("p"))


def test_network_keeps_its_arrays():
    rng = np.random.default_rng(1)
    share = np.full(9, 1 / 9)
    net = lm_score.Network.initial(share)
    padded, at = lm_score.pad(rng.integers(0, 9, 3000).astype(np.uint32), np.array([1000, 0, 2000]), net)
    squares = [np.zeros(p.shape, np.float32) for p in net.params]
    net.step(padded, at[:1024], squares)
    kept = [id(x) for x in net.kept]
    net.step(padded, at[1024:1500], squares)
    want = net.forward(padded, at[:700])[1][np.arange(700), padded[at[:700]]]
    assert np.allclose(net.seen(padded, at[:700]), want, atol=1e-6)
    assert [id(x) for x in net.kept] == kept


def test_near_files_are_read_without_threads(scratch, monkeypatch):
    monkeypatch.setattr(listing, "SLOW", 10)
    for i in range(40):
        with open(f"{scratch}/f{i}", "wb") as f:
            f.write(bytes(128) + b"DICM"[:i % 5] + b"x" * (i % 3))
        os.utime(f"{scratch}/f{i}", ns=(0, 1_700_000_000_123_456_789 + i * 333_333_333))
    os.makedirs(f"{scratch}/d")
    store, paths = listing.Store(scratch), [f"{scratch}/f{i}" for i in range(40)]
    assert store.heads([*paths, f"{scratch}/none"], None) == [*((b"DICM"[:i % 5] + b"x" * (i % 3))[:4].decode() for i in range(40)), None]
    reader = listing.FolderReader({"roots": json.dumps([scratch]), "partitions": "2"})
    got = {r["path"]: r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}
    assert sorted(got) == sorted(paths)
    assert all(r["mtime"] == datetime.datetime.fromtimestamp(os.stat(path).st_mtime, datetime.timezone.utc) for path, r in got.items())
    assert all((got[path]["magic"] is None) == (not listing.wanted(path, got[path]["length"])) for path in paths)
