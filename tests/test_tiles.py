"""Tiled pixel comparison against whole arrays; frames; sides, edges and images that are missing."""

import random

import pytest

from incognita import model
from incognita.operators import pixels, tiles
from incognita.plans import jobs

IMAGE = "pair_id long, frame int, pixels array<int>, n_rows int, n_cols int"


def image(spark, rows):
    return spark.createDataFrame(rows, IMAGE)


def whole(spark, a, b):
    """Pixels by (pair, frame, r, c) of both sides, compared in plain Python."""
    out = {}
    for s, rows in (("a", a), ("b", b)):
        for pair, frame, px, _, cols in rows:
            for i, v in enumerate(px):
                out.setdefault((pair, frame, i // cols, i % cols), {})[s] = v
    return out


@pytest.mark.parametrize("edge", [1, 3, 7, 512])
def test_random_images_against_plain_python_and_the_array_form(spark, edge):
    rng = random.Random(edge)
    a, b, pairs = [], [], []
    for pair in range(25):
        wa, n = rng.randint(1, 12), rng.randint(1, 90)
        wb, m = (wa, n) if pair % 2 else (rng.randint(1, 12), rng.randint(1, 90))
        pa = [rng.randint(0, 3) for _ in range(n)]
        pb = list(pa) if pair % 4 == 1 else [rng.randint(0, 3) for _ in range(m)]
        a.append((pair, 0, pa, -(-n // wa), wa))
        b.append((pair, 0, pb, -(-m // wb), wb))
        pairs.append((pair, pa, pb, -(-n // wa), wa, -(-m // wb), wb))
    ta, tb = tiles.cut(image(spark, a), edge), tiles.cut(image(spark, b), edge)
    got = {r.pair_id: r.asDict() for r in tiles.tile_stats(ta, tb).collect()}
    arrays = pixels.pixel_compare(spark.createDataFrame(pairs, "pair_id long, a array<int>, b array<int>, a_rows int, a_cols int, b_rows int, b_cols int"))
    assert got == {r.pair_id: r.asDict() for r in arrays.collect()}
    diff = sorted(((r.pair_id, r.frame, r.r, r.c, r.a, r.b) for r in tiles.tile_diff(ta, tb).collect()), key=str)
    want = [(*k, v.get("a"), v.get("b")) for k, v in whole(spark, a, b).items() if v.get("a") != v.get("b")]
    assert diff == sorted(want, key=str)
    assert [(f.name, f.dataType) for f in ta.schema] == [(f.name, f.dataType) for f in model.TILES]
    assert ta.count() == ta.select(*tiles.KEY).distinct().count()


def test_frames_and_sides_that_are_missing(spark):
    a = [(1, 0, [1, 2, 3, 4], 2, 2), (1, 1, [5, 6], 1, 2), (2, 0, [7], 1, 1), (3, 0, [], 0, 0), (4, 0, None, 1, 1), (5, 0, [9, 9], 1, 0)]
    b = [(1, 0, [1, 2, 3, 4], 2, 2), (3, 0, [], 0, 0), (4, 0, [1], 1, 1), (5, 0, [9, 9], 1, 0)]
    ta, tb = tiles.cut(image(spark, a), 2), tiles.cut(image(spark, b), 2)
    got = {r.pair_id: (r.header_shape_equal, r.array_shape_equal, r.pixels_equal, r.n_pixels, r.n_mismatch, r.min_a, r.max_b) for r in tiles.tile_stats(ta, tb).collect()}
    assert got == {1: (False, False, False, 6, 2, 1, 4), 2: (False, False, False, 1, 1, 7, None), 3: (True, True, True, 0, 0, None, None),
                   4: (False, False, False, 1, 1, None, 1), 5: (True, True, True, 2, 0, 9, 9)}
    assert {(r.pair_id, r.frame, r.r, r.c, r.a, r.b) for r in tiles.tile_diff(ta, tb).collect()} == {
        (1, 1, 0, 0, 5, None), (1, 1, 0, 1, 6, None), (2, 0, 0, 0, 7, None), (4, 0, 0, 0, None, 1)}
    none = image(spark, [])
    assert tiles.tile_stats(tiles.cut(none), tiles.cut(none)).count() == 0


def test_edges_must_agree(spark):
    one = image(spark, [(1, 0, [1, 2, 3, 4], 2, 2)])
    with pytest.raises(Exception, match="different edges"):
        tiles.tile_stats(tiles.cut(one, 1), tiles.cut(one, 2)).collect()
    with pytest.raises(ValueError):
        tiles.cut(one, 0)


def test_counts_are_merged_before_they_meet_by_pair(spark):
    one = tiles.cut(image(spark, [(1, 0, [1, 2, 3, 4], 2, 2)]), 1)
    plan = tiles.tile_stats(one, one)._jdf.queryExecution().sparkPlan().toString()
    assert "partial_sum" in plan and plan.count("Join FullOuter") + plan.count("FullOuter") >= 1


def test_stored_tiles_job(spark, scratch):
    a = image(spark, [(1, 0, list(range(30)), 5, 6), (2, 0, [1, 1], 1, 2)])
    b = image(spark, [(1, 0, [*range(29), 99], 5, 6), (2, 0, [1, 1], 1, 2)])
    tiles.cut(a, 4).write.parquet(f"{scratch}/a")
    tiles.cut(b, 4).write.parquet(f"{scratch}/b")
    assert jobs.compare_tiles(spark, f"{scratch}/a", f"{scratch}/b", f"{scratch}/out") == {"n_pairs": 2, "n_equal": 1, "n_mismatch": 1}
    r = spark.read.parquet(f"{scratch}/out/diff").first()
    assert (r.r, r.c, r.a, r.b) == (4, 5, 29, 99)
