"""Study-ID pool generation: n unique pseudonyms from a mask.

Draw i yields an ID from ``H(secret || i)`` (see ``functions.masks``). Keeping
the first draw of every ID and the n IDs with the smallest first draw is the
same law as the reference's rejection sampling, and the number of redraws is
exactly ``draws_used - n``. One algorithm serves every n and every mask, so a
pool of n IDs is the beginning of the pool of n + 1. Dedup is one shuffle
(groupBy ID with map-side partial aggregation); the first-n cut is a distributed
consecutive numbering, not a one-task sort. Drawing a full pool takes about
``M ln M`` draws (a plain distributed range) for a mask of M IDs.

The other method, ``method="permuted"``, gives row i the i-th ID of a keyed
permutation of all IDs (``functions.permute``): a plain projection of a range,
without draws, dedup or shuffle, however close n is to the capacity. An
extension is the next range of the same permutation. It is a choice of the
caller, as the two methods give different pools.
"""

from __future__ import annotations

import math
import re
import secrets as _secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.functions import masks, permute
from incognita.functions.ranking import consecutive_index


class PoolRequestError(ValueError):
    pass


@dataclass(frozen=True)
class PoolRequest:
    n: int = model.DEFAULT_POOL_SIZE
    mask: str = model.DEFAULT_MASK
    prefix: str = ""
    suffix: str = ""
    secret: str | None = None
    method: str = "drawn"       # or "permuted"

    def checked(self) -> "PoolRequest":
        m = self.mask.lower().strip("\n")
        if not masks.is_valid(m):
            raise PoolRequestError(f"incorrect study ID format {self.mask!r}: use only u, l, c, d")
        if self.method not in ("drawn", "permuted"):
            raise PoolRequestError(f"unknown method {self.method!r}")
        if self.n <= 0:
            raise PoolRequestError("the number of study IDs must be positive")
        cap = masks.capacity(m)
        if self.n > cap:
            raise PoolRequestError(f"impossible to create {self.n} study IDs with format {m!r} ({cap} possible)")
        if self.method == "permuted" and cap > permute.LIMIT:
            raise PoolRequestError(f"format {m!r} has {cap} IDs, more than {permute.LIMIT} cannot be permuted: draw them")
        return PoolRequest(self.n, m, self.prefix, self.suffix, self.secret or _secrets.token_hex(16), self.method)


def status(n: int, cap: int, valid: bool = True) -> str:
    if not valid:
        return "invalid"
    if n > cap:
        return "impossible"
    if n > model.SLOW_POOL_FRACTION * cap:
        return "slow"
    return "ok"


def warnings(req: PoolRequest) -> list[str]:
    """What the creator of a pool should know: it uses nearly all IDs, or its IDs are longer than DICOM allows."""
    out = []
    cap = masks.capacity(req.mask)
    if status(req.n, cap) == "slow":
        out.append(f"Warning: {req.n} of the {cap} study IDs of format {req.mask!r} are used")
    length = len(req.prefix) + len(req.mask) + len(req.suffix)
    if length > model.MAX_ID_LENGTH:
        out.append(f"Warning: study IDs have {length} characters, more than {model.MAX_ID_LENGTH}")
    return out


def draws_for(n: int, cap: int) -> int:
    """Draws expected to give n distinct IDs (coupon collector), with 20 % margin."""
    expected = cap * (math.log(cap) + 0.5773) if n >= cap else n if cap > 1 << 200 else -cap * math.log1p(-n / cap)
    return int(math.ceil(1.2 * expected)) + 16


def first_draws(spark: SparkSession, req: PoolRequest, n_draws: int) -> DataFrame:
    """study_id and its first draw among draws 0 .. n_draws - 1."""
    d = spark.range(n_draws).withColumnRenamed("id", "draw")
    ids = d.select("draw", masks.draw_id(F.col("draw"), req.secret, req.mask, req.prefix, req.suffix).alias("study_id"))
    return ids.groupBy("study_id").agg(F.min("draw").alias("first_draw"))


def _first_n(n: int, n_draws: int, draws) -> DataFrame:
    """The first n IDs in draw order, numbered ``idx`` from 1; draws on until there are n."""
    while True:
        ranked = consecutive_index(draws(n_draws), ["first_draw"], name="idx")
        if (ranked.agg(F.max("idx")).first()[0] or 0) >= n:
            return ranked.where(F.col("idx") <= n)
        n_draws *= 2  # the first draws are unchanged, so the result is the same law


def generate(spark: SparkSession, req: PoolRequest) -> DataFrame:
    """Pool rows: row_no (2..n+1), study_id, first_draw."""
    req = req.checked()
    if req.method == "permuted":
        return permuted(spark, req, 0, 2)
    chosen = _first_n(req.n, draws_for(req.n, masks.capacity(req.mask)), lambda k: first_draws(spark, req, k))
    return chosen.select((F.col("idx") + 1).cast("bigint").alias("row_no"), "study_id", "first_draw")


def permuted(spark: SparkSession, req: PoolRequest, start: int, first_row: int) -> DataFrame:
    """IDs ``start`` .. ``start + n - 1`` of the permutation, from row ``first_row`` on; ``first_draw`` is the ID's number in it."""
    cap = masks.capacity(req.mask)
    if start + req.n > cap:
        raise PoolRequestError(f"cannot add {req.n} IDs after {start}: format {req.mask!r} has {cap}")
    code = permute.permuted(F.col("id"), cap, req.secret)
    return spark.range(start, start + req.n).select((F.col("id") - start + first_row).alias("row_no"),
                                                    masks.decode_code(code, req.mask, req.prefix, req.suffix).alias("study_id"), F.col("id").alias("first_draw"))


def of_form(req: PoolRequest) -> Column:
    """Whether ``study_id`` is an ID that the request's mask, prefix and suffix can give."""
    letters = [ch for ch in masks.normalise(req.mask) if ch in model.MASK_ALPHABETS]
    return F.col("study_id").rlike("\\A" + re.escape(req.prefix) + "".join(f"[{model.MASK_ALPHABETS[ch]}]" for ch in letters) + re.escape(req.suffix) + "\\z")


def extend(spark: SparkSession, existing: DataFrame, req: PoolRequest, first_row: int) -> DataFrame:
    """``req.n`` more IDs, none equal to an ID of ``existing`` (its ``study_id`` column).

    Draws run as in ``generate``; IDs already in the pool are removed with an
    anti-join (the pool's counted size decides broadcast or shuffle), and the
    first ``req.n`` survivors in draw order take rows ``first_row``... It is
    refused only if the IDs of the mask's form that are not in the pool are too
    few. A permuted pool goes on after its IDs of that form.
    """
    from incognita.operators.registry_ops import bounded_broadcast

    req = req.checked()
    cap = masks.capacity(req.mask)
    taken = existing.select("study_id").where(F.coalesce("study_id", F.lit("")) != "").distinct()
    size = taken.agg(F.count(F.lit(1)).alias("n"), F.count_if(of_form(req)).alias("own"), F.max(F.octet_length("study_id")).alias("w")).first()
    if size["own"] + req.n > cap:
        raise PoolRequestError(f"cannot add {req.n} IDs to a pool that has {size['own']} of the {cap} of format {req.mask!r}")
    if req.method == "permuted":
        more = permuted(spark, req, size["own"], first_row)
        if not more.join(bounded_broadcast(taken, size["n"], (size["w"] or 0) + 48), "study_id", "left_semi").isEmpty():
            raise PoolRequestError("the pool's IDs are not the beginning of this permutation: give its secret, or draw the IDs")
        return more
    taken = bounded_broadcast(taken, size["n"], (size["w"] or 0) + 48)
    chosen = _first_n(req.n, draws_for(min(size["own"] + req.n, cap), cap),
                      lambda k: first_draws(spark, req, k).join(taken, "study_id", "left_anti"))
    return chosen.select((F.col("idx") + first_row - 1).cast("bigint").alias("row_no"), "study_id", "first_draw")


def pool_stats(pool: DataFrame, req: PoolRequest) -> DataFrame:
    """Requested n, capacity, draws used and collisions (redraws) of a generated pool."""
    cap = masks.capacity(req.mask)
    return pool.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_ids"),
        F.countDistinct("study_id").cast("bigint").alias("n_distinct"),
        (F.max("first_draw") + 1).cast("bigint").alias("draws_used"),
        (F.max("first_draw") + 1 - F.count(F.lit(1))).cast("bigint").alias("collisions"),
    ).select(F.lit(req.n).cast("bigint").alias("n_requested"), F.lit(str(cap)).alias("capacity"), "*")


def empty_slots(pool: DataFrame) -> DataFrame:
    """A new registry's slot table from a generated pool."""
    cols = []
    for f in model.SLOTS.fields:
        if f.name in ("row_no", "study_id"):
            cols.append(F.col(f.name).cast(f.dataType))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return pool.select(*cols)


def clean_registry_name(name: str) -> str:
    """Spaces become '_' and dots are removed."""
    return name.replace(" ", "_").replace(".", "")
