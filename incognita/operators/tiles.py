"""Pixel comparison of images of any size: both sides cut into tiles, tiles joined, results merged.

An image that does not fit a row, or has several frames, is stored as rows of
``model.TILES``: one per ``edge`` x ``edge`` square of its grid, with the pixels of that
square row by row. Tiles of both sides meet by (pair, frame, tile), so the pixels of one
pair spread over all tasks; only counts, minima and maxima come together by pair, and
they are merged before the shuffle. The results equal ``operators.pixels`` on the whole
arrays.

A pixel, tile or frame that only one side has counts as mismatches. An image
without pixels is one empty tile, so its pair stays; a null image has no tiles. Tiles of
different edges are refused. A tile that is there twice on one side is compared twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.operators import pixels

KEY = ["pair_id", "frame", "tile_row", "tile_col"]

#: A tile of 512 x 512 four-byte pixels is 1 MB.
EDGE = 512


def cut(images: DataFrame, edge: int = EDGE) -> DataFrame:
    """Tiles of images (pair_id, pixels, n_rows, n_cols and, if there are several, frame)."""
    if edge < 1:
        raise ValueError("edge must be at least 1")
    frame = F.col("frame").cast("int") if "frame" in images.columns else F.lit(0)
    size = F.size("pixels")
    wide = F.when(F.col("n_cols") > 0, F.col("n_cols")).otherwise(F.greatest(size, F.lit(1)))
    laid = images.where(F.col("pixels").isNotNull()).select(
        "pair_id", frame.alias("frame"), "pixels", "n_rows", "n_cols", wide.cast("int").alias("wide"), size.alias("n"))
    down, across = F.ceil(F.col("n") / F.col("wide")).cast("int"), F.least("wide", F.greatest("n", F.lit(1)))
    last_row, last_col = F.floor((F.greatest(down, F.lit(1)) - 1) / edge).cast("int"), F.floor((across - 1) / edge).cast("int")
    placed = (laid.withColumn("tile_row", F.explode(F.sequence(F.lit(0), last_row)))
              .withColumn("tile_col", F.explode(F.sequence(F.lit(0), last_col))))
    first, left = F.col("tile_row") * edge, F.col("tile_col") * edge
    width = F.least(F.lit(edge), F.col("wide") - left)
    rows = F.greatest(F.least(F.lit(edge), down - first), F.lit(0))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(rows, F.lit(1)) - 1), lambda k: _line((first + k) * F.col("wide") + left, width))
    return placed.select(*KEY, F.lit(edge).alias("edge"), "n_rows", "n_cols", width.cast("int").alias("width"), F.flatten(lines).alias("pixels"))


def _line(start: Column, width: Column) -> Column:
    """A tile's part of one image row; the image's last row may end before it."""
    return F.slice("pixels", (start + 1).cast("int"), F.greatest(F.least(width, F.col("n") - start), F.lit(0)).cast("int"))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiles of both sides as small image pairs; a side that has none gets an empty array."""
    def side(tiles: DataFrame, s: str) -> DataFrame:
        return tiles.select(*KEY, F.col("edge").alias(s + "_edge"), F.col("n_rows").alias(s + "_n_rows"), F.col("n_cols").alias(s + "_n_cols"),
                            F.col("width").alias(s + "_width"), F.col("pixels").alias(s))

    both = side(a, "a").join(side(b, "b"), KEY, "full")
    unlike = F.col("a_edge") != F.col("b_edge")
    empty = F.array().cast("array<int>")
    checked = F.when(unlike, F.raise_error(F.lit("tiles of different edges cannot be compared"))).otherwise(F.coalesce("a", empty))
    return both.select(*KEY, F.coalesce("a_edge", "b_edge").alias("edge"), "a_n_rows", "a_n_cols", "b_n_rows", "b_n_cols", checked.alias("a"), F.coalesce("b", empty).alias("b"),
                       F.coalesce("a_width", "b_width").alias("a_cols"), F.coalesce("b_width", "a_width").alias("b_cols"))


def tile_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """By pair: equal shapes, equal pixels, counts, minima and maxima of both sides over all tiles and frames."""
    part = pixels.statistics(_met(a, b).withColumns({"n_a": F.size("a"), "n_b": F.size("b")}),
                             "pair_id", "frame", "n_a", "n_b", "a_n_rows", "a_n_cols", "b_n_rows", "b_n_cols")
    # A frame's tiles all carry its header shape; a side without the frame has none.
    shape = [F.max(f"{s}_n_{x}").alias(f"{s}_{x}") for s in ("a", "b") for x in ("rows", "cols")]
    merged = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_pixels", "n_mismatch")]
    ends = [f(f"{n}_{s}").alias(f"{n}_{s}") for s in ("a", "b") for n, f in (("min", F.min), ("max", F.max))]
    frames = part.groupBy("pair_id", "frame").agg(*shape, *merged, *ends)
    header = F.coalesce((F.col("a_rows") == F.col("b_rows")) & (F.col("a_cols") == F.col("b_cols")), F.lit(False))
    by_pair = frames.groupBy("pair_id").agg(F.bool_and(header).alias("header_shape_equal"), F.bool_and(header & (F.col("n_a") == F.col("n_b"))).alias("array_shape_equal"),
                                            *[F.sum(c).alias(c) for c in ("n_pixels", "n_mismatch")], *ends)
    return by_pair.select("pair_id", "header_shape_equal", "array_shape_equal", (F.col("array_shape_equal") & (F.col("n_mismatch") == 0)).alias("pixels_equal"),
                          "n_pixels", "n_mismatch", "min_a", "max_a", "min_b", "max_b")


def tile_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per differing pixel: pair_id, frame, r, c, a, b."""
    found = pixels.differing(_met(a, b), *KEY, "edge")
    return found.select("pair_id", "frame", (F.col("tile_row") * F.col("edge") + F.col("r")).cast("bigint").alias("r"),
                        (F.col("tile_col") * F.col("edge") + F.col("c")).cast("bigint").alias("c"), "a", "b")
