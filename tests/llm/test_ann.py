import math

import numpy as np
import pytest

from incognita.llm import ann as A


def exact(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in sorted(rows, key=lambda r: r[0])]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % every == 0:
            s = np.einsum("j,ij->i", v, x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_hilbert_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = A.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)].astype(int), axis=0)).sum(1) == 1).all()


def test_full_windows_are_exact_with_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(1) * rng.uniform(0.5, 2, (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(120)]
    got = found(A.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 10, span=64))
    want = exact(rows, 10, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], rtol=0, atol=1e-12)


def test_recall_with_narrow_windows_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    got = found(A.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5), 20, share=0, least=150, span=256))
    want = exact(rows, 20, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall > 0.9


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_the_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got = found(A.nearest(df, 20, least=256, span=1024))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_awkward_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (20, [0.5, 0.5], 2), (1, [2.0, 0.0], 3), (2, [0.0, 0.0], 4), (3, None, 5), (4, [], 6), (5, [nan, 1.0], 7), (6, [inf, 1.0], 8),
            (7, [None, 1.0], 9), (None, [1.0, 1.0], 10), (8, [3.0], 11), (40, [0.0, 0.0], 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, curve int")
    got = found(A.nearest(df, 20))
    assert got == {0: [(8, 3.0), (1, 2.0), (20, 0.5)], 20: [(8, 1.5), (1, 1.0), (0, 0.5)]}
    assert A.nearest(df.limit(0), 20).count() == 0
    assert A.nearest(df.where("vec_id = 0"), 20).count() == 0
