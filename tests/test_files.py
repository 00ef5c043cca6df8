"""binaryFile scan over a real directory tree (two roots)."""

import json
import os
import random

from pyspark.sql import functions as F

from incognita.sources import files, listing


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan_two_roots(spark, scratch):
    a, b = f"{scratch}/studyA", f"{scratch}/studyAB"
    dicom = b"\0" * 128 + b"DICM" + b"\x02\x00" * 20
    write(f"{a}/p1/x1.dcm", dicom)
    write(f"{a}/p1/DICOMDIR", dicom)
    write(f"{a}/short.dcm", b"tiny")
    write(f"{a}/p2/sub/junk.txt", b"x" * 200)
    write(f"{b}/y.dcm", dicom)
    inv = files.with_magic(spark, [a, b]).collect()
    got = {os.path.basename(r.path): (r.root, r.root_ord, r.magic) for r in inv}
    assert got["x1.dcm"] == (a, 0, "DICM")
    assert got["y.dcm"] == (b, 1, "DICM")  # longest matching root, not the prefix 'studyA'
    assert got["short.dcm"][2] is None
    assert got["junk.txt"][2] == "x" * 4
    counts = {r.root: (r.n_files, r.n_dirs) for r in files.dir_counts(files.inventory(spark, [a, b])).collect()}
    assert counts[a] == (4, 3) and counts[b] == (1, 1) and counts[None] == (5, 4)


def test_inventory_opens_no_file(spark, scratch):
    write(f"{scratch}/r/f.dcm", b"0" * 500)
    os.symlink("/nowhere", f"{scratch}/r/dangling")
    got = files.inventory(spark, [f"{scratch}/r"]).collect()
    assert [(r.path, r.length) for r in got] == [(f"{scratch}/r/f.dcm", 500)]
    assert listing.listed(spark, [f"{scratch}/r"], heads=0).collect()[0].magic is None


def test_each_file_is_listed_once_whatever_the_partitions(spark, scratch):
    rng = random.Random(7)
    want = {}
    for i in range(400):
        folder = "/".join(rng.choices(["a", "b", "_c", ".d"], k=rng.randint(0, 5))) if i % 3 else "hot/flat"
        path = f"{scratch}/t/{folder}/f{i}.dcm".replace("//", "/")
        data = b"\0" * 128 + rng.choice([b"DICM", b"JUNK"]) + b"x" * rng.randint(0, 9) if i % 5 else b"short"
        write(path, data)
        want[path] = data[128:132].decode() or None
    os.symlink(f"{scratch}/t", f"{scratch}/t/a/loop")
    roots = [f"{scratch}/t", f"{scratch}/t/hot"]  # the second lies in the first
    for partitions, heads in ((1, 10_000), (4, 20), (1000, 0)):
        got = listing.listed(spark, roots, heads, partitions).checkpoint()
        rows = got.collect()
        assert sorted(r.path for r in rows) == sorted(want)
        assert {r.path for r in rows if r.root_ord == 1} == {p for p in want if "/t/hot/" in p}
        if heads:
            assert {r.path: r.magic for r in listing.with_heads(got).collect()} == want
            assert any(r.pending for r in rows) == (heads == 20)


def test_driver_keeps_folders_only(scratch):
    for i in range(30):
        write(f"{scratch}/t/p{i % 3}/s{i % 6}/f{i}.dcm", b"x")
    reader = listing.FolderReader({"roots": json.dumps([f"{scratch}/t"]), "partitions": "3"})
    parts = reader.partitions()
    assert sorted((os.path.relpath(p.folder, scratch), p.deep) for p in parts) == [("t", False), ("t/p0", True), ("t/p1", True), ("t/p2", True)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 30


def test_prescreen_tree(spark, scratch):
    from incognita.operators import screen

    dicom = b"\0" * 128 + b"DICM" + b"\0" * 8
    write(f"{scratch}/t/a/x.dcm", dicom)
    write(f"{scratch}/t/a/LOCKFILE", dicom)
    write(f"{scratch}/t/b/short", b"abc")
    got = {os.path.basename(r.path): (r.outcome, r.message)
           for r in screen.prescreen(files.with_magic(spark, [f"{scratch}/t"])).collect()}
    assert got == {"x.dcm": ("candidate", None), "LOCKFILE": ("skiplist", "LOCKFILE"),
                   "short": ("not_dicom", "short: fourcc failed- non-dicom")}
