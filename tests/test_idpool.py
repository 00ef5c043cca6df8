"""Masks, capacity, pool generation."""

import re

import pytest
from pyspark.sql import functions as F

from incognita import model
from incognita.functions import masks, permute
from incognita.operators import idpool

FIXTURE_MASKS = ["uudddd", "ldd", "d", "c", "LD", "uxd", "", "uuuuuuuuuuuu"]
CAPACITIES = [6760000, 2600, 10, 52, 260, 260, 0, 95428956661682176]


def test_capacity_python_and_column_agree(spark):
    assert [masks.capacity(m) for m in FIXTURE_MASKS] == CAPACITIES
    df = spark.createDataFrame([(m,) for m in FIXTURE_MASKS], "mask string")
    got = [int(r[0]) for r in df.select(masks.capacity_col(F.col("mask"))).collect()]
    assert got == CAPACITIES


def test_capacity_does_not_overflow(spark):
    df = spark.createDataFrame([("c" * 16,)], "mask string")
    assert int(df.select(masks.capacity_col(F.col("mask"))).first()[0]) == 52 ** 16


def test_validation(spark):
    assert [masks.is_valid(m) for m in FIXTURE_MASKS] == [True, True, True, True, True, False, False, True]
    df = spark.createDataFrame([(m,) for m in FIXTURE_MASKS], "mask string")
    assert [r[0] for r in df.select(masks.valid_col(F.col("mask"))).collect()] == \
        [True, True, True, True, True, False, False, True]


def test_decode_is_a_bijection(spark):
    df = spark.range(2600).select(masks.decode_code(F.col("id"), "ldd").alias("s"))
    vals = [r.s for r in df.collect()]
    assert len(set(vals)) == 2600 and vals[0] == "a00" and vals[-1] == "z99"


def test_generate_smoke_request(spark):
    req = idpool.PoolRequest(n=50, mask="ldd", prefix="TEST-", suffix="END", secret="s1")
    pool = idpool.generate(spark, req).cache()
    rows = pool.collect()
    assert sorted(r.row_no for r in rows) == list(range(2, 52))
    ids = [r.study_id for r in rows]
    assert len(set(ids)) == 50 and all(re.fullmatch(r"TEST-[a-z][0-9]{2}END", i) for i in ids)
    again = {r.study_id for r in idpool.generate(spark, req).collect()}
    assert again == set(ids)  # reproducible from the secret
    st = idpool.pool_stats(pool, req).first()
    assert st.n_ids == 50 and st.collisions == st.draws_used - 50


def test_near_full_pool(spark):
    pool = idpool.generate(spark, idpool.PoolRequest(n=9, mask="d", secret="s")).collect()
    assert len({r.study_id for r in pool}) == 9


def test_refusals():
    with pytest.raises(idpool.PoolRequestError):
        idpool.PoolRequest(n=11, mask="d").checked()
    with pytest.raises(idpool.PoolRequestError):
        idpool.PoolRequest(n=5, mask="uxd").checked()
    with pytest.raises(idpool.PoolRequestError):
        idpool.PoolRequest(n=0, mask="d").checked()
    assert idpool.status(99, 100) == "slow" and idpool.status(50, 100) == "ok"
    assert idpool.clean_registry_name("my study.v2") == "my_studyv2"


@pytest.mark.parametrize("mask", ["dd", "ld"])
def test_a_pool_is_the_beginning_of_every_larger_one(spark, mask):
    cap = masks.capacity(mask)
    pools = {n: [r.study_id for r in idpool.generate(spark, idpool.PoolRequest(n=n, mask=mask, secret="k:")).orderBy("row_no").collect()]
             for n in (1, cap // 2, cap // 2 + 1, cap)}
    for small, large in ((1, cap // 2), (cap // 2, cap // 2 + 1), (cap // 2 + 1, cap)):
        assert pools[large][:small] == pools[small]
    assert len(set(pools[cap])) == cap


def test_masks_of_any_length(spark):
    for mask in ("uuuuudddddddd", "c" * 16, "c" * 30):
        ids = [r.study_id for r in idpool.generate(spark, idpool.PoolRequest(n=40, mask=mask, secret="w")).collect()]
        assert len(set(ids)) == 40 and all(len(i) == len(mask) for i in ids)
        assert all(c in model.MASK_ALPHABETS[m] for i in ids for c, m in zip(i, mask, strict=True))


def test_column_forms_never_fail_and_agree_with_python(spark):
    rows = ["uu\ndd", "\nuudd\n", "uudd\n", "c" * 22, "c" * 23, "c" * 40, "u d", " uudd"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, mask string")
    got = df.select("i", masks.valid_col(F.col("mask")).alias("v"), masks.capacity_col(F.col("mask")).alias("c"), masks.log10_capacity_col(F.col("mask")).alias("g")).orderBy("i").collect()
    assert [r.v for r in got] == [masks.is_valid(m) for m in rows]
    assert [r.c is None for r in got] == [len(m) >= 23 for m in rows]
    assert got[5].g == pytest.approx(40 * 1.7160033436347992)


def test_extending_past_the_mask_is_refused_and_up_to_it_is_not(spark):
    pool = idpool.generate(spark, idpool.PoolRequest(n=7, mask="d", secret="a"))
    more = idpool.extend(spark, pool, idpool.PoolRequest(n=3, mask="d", secret="b"), 9)
    assert {r.study_id for r in pool.union(more).collect()} == set("0123456789")
    with pytest.raises(idpool.PoolRequestError):
        idpool.extend(spark, pool, idpool.PoolRequest(n=4, mask="d", secret="b"), 9)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 26, 100, 676, 1000])
def test_permutation_is_one_and_equals_plain_python(spark, n):
    got = {r.id: r.y for r in spark.range(n).select("id", permute.permuted(F.col("id"), n, "key").alias("y")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(got[i] == permute.permute(i, n, "key") for i in got)


def test_permutation_of_many_numbers(spark):
    n = permute.LIMIT
    xs = [0, 1, 2**31, 2**53 + 1, n - 1]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x bigint").select(permute.permuted(F.col("x"), n, "z").alias("y")).collect()]
    assert sorted(got) == sorted(permute.permute(x, n, "z") for x in xs)


def test_permuted_pools_and_their_extensions(spark):
    req = idpool.PoolRequest(n=700, mask="ddd", prefix="A.", secret="s", method="permuted")
    pool = idpool.generate(spark, req)
    assert "Exchange" not in pool._jdf.queryExecution().executedPlan().toString()
    more = idpool.extend(spark, pool, idpool.PoolRequest(n=300, mask="ddd", prefix="A.", secret="s", method="permuted"), 702)
    both = pool.unionByName(more).collect()
    assert sorted(r.row_no for r in both) == list(range(2, 1002)) and len({r.study_id for r in both}) == 1000
    assert [r.study_id for r in sorted(both, key=lambda r: r.row_no)][:3] == [f"A.{permute.permute(i, 1000, 's'):03d}" for i in range(3)]
    with pytest.raises(idpool.PoolRequestError, match="cannot add"):
        idpool.extend(spark, pool, idpool.PoolRequest(n=301, mask="ddd", prefix="A.", secret="s", method="permuted"), 702)
    with pytest.raises(idpool.PoolRequestError, match="not the beginning"):
        idpool.extend(spark, pool, idpool.PoolRequest(n=300, mask="ddd", prefix="A.", secret="other", method="permuted"), 702)
    with pytest.raises(idpool.PoolRequestError, match="cannot be permuted"):
        idpool.generate(spark, idpool.PoolRequest(n=3, mask="c" * 12, method="permuted"))


def test_all_remaining_ids_can_be_added_whatever_else_the_pool_holds(spark):
    foreign = spark.range(100).selectExpr("concat('X', id) study_id").unionByName(spark.range(40).selectExpr("lpad(id, 2, '0') study_id")).checkpoint()
    for secret in ("j", "k", "l"):
        more = idpool.extend(spark, foreign, idpool.PoolRequest(n=60, mask="dd", secret=secret), 200)
        assert {r.study_id for r in more.collect()} == {f"{i:02d}" for i in range(40, 100)}
    with pytest.raises(idpool.PoolRequestError, match="has 40 of the 100"):
        idpool.extend(spark, foreign, idpool.PoolRequest(n=61, mask="dd", secret="j"), 200)
