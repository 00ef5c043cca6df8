"""A keyed permutation of 0 .. n - 1 as a Column expression.

A number is split into two digits of base ``a`` (the least with a * a >= n), which
a Feistel network of ``ROUNDS`` rounds permutes: (l, r) becomes
(r, (l + f(r)) mod a), f being 48 bits of a keyed hash. Numbers that land
outside 0 .. n - 1 are permuted again until they are inside (cycle walking), so
distinct numbers stay distinct. Nothing is drawn twice, stored or compared.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Walks that are tried; a * a exceeds n by 2 a at most, so beyond a few hundred numbers hardly any walk takes three steps.
WALKS = 64
#: Numbers that can be permuted: sums of two digits stay within 64 bits.
LIMIT = 1 << 62


def base(n: int) -> int:
    return math.isqrt(n - 1) + 1 if n > 1 else 1


def walks(n: int) -> int:
    """Steps after which every walk has ended: no walk meets more numbers outside than there are."""
    return min(base(n) ** 2 - n, WALKS)


def permuted(x: Column, n: int, key: str) -> Column:
    """The place of ``x`` (0 <= x < n) in the permutation that ``key`` picks."""
    if not 0 < n <= LIMIT:
        raise ValueError(f"cannot permute {n} numbers")
    a = base(n)

    def step(state: Column, number: Column) -> Column:
        text = F.concat(F.lit(key + ":"), number.cast("string"), F.lit(":"), state["r"].cast("string"))
        f = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")
        return F.struct(state["r"].alias("l"), ((state["l"] + f) % F.lit(a).cast("bigint")).alias("r"))

    def once(value: Column) -> Column:
        low = value % F.lit(a).cast("bigint")
        start = F.struct(((value - low).cast("decimal(20,0)") / F.lit(a)).cast("bigint").alias("l"), low.alias("r"))  # an exact multiple, in decimals
        rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
        return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(a).cast("bigint") + s["r"])

    inside = F.lit(n).cast("bigint")
    walk = once(x.cast("bigint"))
    if walks(n):
        steps = F.sequence(F.lit(1), F.lit(walks(n)))
        walk = F.aggregate(steps, walk, lambda y, _: F.when(y < inside, y).otherwise(once(y)))
        lost = F.raise_error(F.lit(f"a walk left 0 .. {n - 1} for more than {WALKS} steps: choose another key")).cast("bigint")
        walk = F.when(walk < inside, walk).otherwise(lost)
    return walk


def permute(x: int, n: int, key: str) -> int:
    """The same of one number, in plain Python."""
    a = base(n)
    while True:
        left, right = divmod(x, a)
        for i in range(ROUNDS):
            f = int(hashlib.sha256(f"{key}:{i}:{right}".encode()).hexdigest()[:12], 16)
            left, right = right, (left + f) % a
        x = left * a + right
        if x < n:
            return x
