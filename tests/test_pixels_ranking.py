"""Pixel comparison edge cases and distributed numbering."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from incognita.functions.ranking import consecutive_index
from incognita.operators import pixels


def test_pixels_different_sizes(spark):
    pairs = spark.createDataFrame([(1, [1, 2, 3, 4], [1, 2, 3, 4], 2, 2, 2, 2),
                                   (2, [1, 2, 3], [1, 5], 1, 3, 1, 2)],
                                  "pair_id long, a array<int>, b array<int>, a_rows int, a_cols int, b_rows int, b_cols int")
    eq = {r.pair_id: r for r in pixels.pixel_equal(pairs).collect()}
    assert eq[1].pixels_equal and not eq[2].pixels_equal and not eq[2].array_shape_equal
    st = {r.pair_id: r for r in pixels.pixel_stats(pairs).collect()}
    assert (st[2].n_pixels, st[2].n_mismatch, st[2].max_a, st[2].min_b) == (3, 2, 3, 1)
    diff = sorted((r.i, r.a, r.b) for r in pixels.pixel_diff(pairs).collect())
    assert diff == [(1, 2, 5), (2, 3, None)]


def test_consecutive_index_matches_row_number(spark):
    df = spark.range(20000).repartition(7).select(
        (F.col("id") * 7919 % 20011).alias("k"), F.col("id"))
    got = consecutive_index(df, ["k", "id"], name="idx", start=5, num_partitions=6)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")) + 4)
    assert got.join(ref, ["k", "id"]).where(F.col("idx") != F.col("rn")).count() == 0
    assert got.count() == 20000
    assert got.agg(F.min("idx"), F.max("idx")).first() == (5, 20004)
