"""Pixel comparison of image pairs (before / after de-identification).

A pair row holds both images as row-major ``ARRAY<INT>`` plus their header
shapes (``model.PIXEL_PAIRS``). Pixels are compared by row and column: images of
equal width position by position, others on the grid that covers both. A pixel
that only one image has counts as a mismatch. Equality, statistics and mismatch
counts are array functions on the row (narrow, codegen'd); only mismatching
pixels are ever exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns(side: str) -> Column:
    """Width of an image; one that holds no valid width is a single row."""
    cols = F.col(side + "_cols")
    return F.when(cols > 0, cols).otherwise(F.greatest(F.size(side), F.lit(1)))


def _rows(side: str) -> Column:
    return F.ceil(F.size(side) / _columns(side)).cast("int")


def _pixel(side: str, r: Column, c: Column) -> Column:
    return F.when(c < _columns(side), F.get(F.col(side), (r * _columns(side) + c).cast("int")))


def _numbers(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _same_width() -> Column:
    return _columns("a") == _columns("b")


def _wide() -> Column:
    return F.greatest(_columns("a"), _columns("b"))


def _longest() -> Column:
    return F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest(F.size("a"), F.size("b")))


def _grid() -> Column:
    """Numbers, row-major, of the cells of the grid that covers images of unequal width."""
    return _numbers(F.greatest(_rows("a"), _rows("b")) * _wide())


def _cells() -> Column:
    """(i, r, c, a, b) structs of the pixels; i counts row-major on the grid that covers both images."""
    wide = _wide()
    equal = F.transform(F.arrays_zip("a", "b"), lambda ab, i: F.struct(
        i.cast("bigint").alias("i"), F.floor(i / wide).cast("bigint").alias("r"), (i % wide).cast("bigint").alias("c"),
        ab["a"].alias("a"), ab["b"].alias("b")))

    def cell(i: Column) -> Column:
        r, c = F.floor(i / wide), i % wide
        return F.struct(i.cast("bigint").alias("i"), r.cast("bigint").alias("r"), c.cast("bigint").alias("c"),
                        _pixel("a", r, c).alias("a"), _pixel("b", r, c).alias("b"))

    n = F.greatest(_rows("a"), _rows("b")) * wide
    grid = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cell), lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    return F.when(_columns("a") == _columns("b"), equal).otherwise(grid)


def _mismatches() -> Column:
    return F.filter(_cells(), lambda x: ~x["a"].eqNullSafe(x["b"]))


def _equality() -> list[Column]:
    header = (F.col("a_rows") == F.col("b_rows")) & (F.col("a_cols") == F.col("b_cols"))
    shape = header & (F.size("a") == F.size("b"))
    return [header.alias("header_shape_equal"), shape.alias("array_shape_equal"),
            (shape & F.col("a").eqNullSafe(F.col("b"))).alias("pixels_equal")]


def _statistics() -> list[Column]:
    """Counts from array sizes; cells are only built for images of unequal width, pixels only compared where the arrays differ."""
    def held(i: Column) -> Column:
        r, c = F.floor(i / _wide()), i % _wide()
        return _pixel("a", r, c).isNotNull() | _pixel("b", r, c).isNotNull()

    def differs(i: Column) -> Column:
        r, c = F.floor(i / _wide()), i % _wide()
        return ~_pixel("a", r, c).eqNullSafe(_pixel("b", r, c))

    unequal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    cells = F.when(_same_width(), _longest()).otherwise(F.size(F.filter(_grid(), held)))
    wrong = (F.when(_same_width() & (F.col("a") == F.col("b")), F.lit(0)).when(_same_width(), unequal)
             .otherwise(F.size(F.filter(_grid(), differs))))
    return [cells.cast("bigint").alias("n_pixels"), wrong.cast("bigint").alias("n_mismatch"),
            *[f(side).alias(f"{name}_{side}") for side in ("a", "b") for name, f in (("min", F.array_min), ("max", F.array_max))]]


def statistics(pairs: DataFrame, *carried: str) -> DataFrame:
    """Counts, minima and maxima of each row's two images, beside ``carried`` columns."""
    return pairs.select(*carried, *_statistics())


def differing(pairs: DataFrame, *carried: str) -> DataFrame:
    """One row per differing pixel of each row's two images, beside ``carried`` columns: i, r, c, a, b."""
    same = F.col("a").eqNullSafe(F.col("b")) & (_columns("a") == _columns("b"))
    return pairs.where(~same).select(*carried, F.explode(_mismatches()).alias("x")).select(*carried, "x.*")


def pixel_equal(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", *_equality())


def pixel_stats(pairs: DataFrame) -> DataFrame:
    return statistics(pairs, "pair_id")


def pixel_compare(pairs: DataFrame) -> DataFrame:
    """Equality and statistics of each pair in one narrow pass."""
    return pairs.select("pair_id", *_equality(), *_statistics())


def pixel_diff(pairs: DataFrame) -> DataFrame:
    """One row per differing pixel: pair_id, i, r, c, a, b."""
    return differing(pairs, "pair_id")
