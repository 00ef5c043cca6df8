"""Study-ID masks: validation, capacity, keyed draws and decoding.

A mask is a string of letters c/u/l/d; each letter becomes one random symbol
from its alphabet. An ID is ``prefix + symbols + suffix``. A draw is the
first 60 bits of ``sha256(secret || draw_number)`` reduced modulo the mask
capacity, so a pool is reproducible from (secret, mask) and recomputation
after a lost executor gives the same IDs. A mask of 2^50 IDs or more is drawn
in groups of eight letters, each from a hash of its own, so that 60 bits stay
far more than a group needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita import model


def normalise(mask: str) -> str:
    """Lower-case the mask and strip surrounding whitespace/newlines."""
    return mask.lower().strip()


def capacity(mask: str) -> int:
    """Number of distinct IDs a mask can produce; 0 for an empty mask.

    Letters outside c/u/l/d contribute nothing (they are ignored).
    """
    m = normalise(mask)
    if not m:
        return 0
    cap = 1
    for ch in m:
        alphabet = model.MASK_ALPHABETS.get(ch)
        if alphabet:
            cap *= len(alphabet)
    return cap


def is_valid(mask: str) -> bool:
    m = mask.lower().strip("\n")
    return bool(m) and all(ch in model.MASK_ALPHABETS for ch in m)


# --- Column forms (for tables of masks) -------------------------------------

def valid_col(mask: Column) -> Column:
    """Mask validation as a column: only c/u/l/d after lower-casing; empty rejected.

    Newlines are stripped at the ends only, as ``is_valid`` does.
    """
    return F.lower(F.regexp_replace(mask, r"\A\n+|\n+\z", "")).rlike(r"\A[dluc]+\z")


def _alphabet_sizes(mask: Column) -> Column:
    letters = F.split(F.lower(F.trim(mask)), "")
    return F.transform(letters, lambda ch: F.when(ch == "c", 52).when(ch == "u", 26)
                       .when(ch == "l", 26).when(ch == "d", 10).otherwise(1))


def log10_capacity_col(mask: Column) -> Column:
    """log10 of the capacity, for masks of any length."""
    return F.aggregate(_alphabet_sizes(mask), F.lit(0.0), lambda acc, x: acc + F.log10(x.cast("double")))


def capacity_col(mask: Column) -> Column:
    """Capacity as DECIMAL(38,0); NULL where it has more digits (see ``log10_capacity_col``)."""
    prod = F.aggregate(_alphabet_sizes(mask), F.lit(1).cast("decimal(38,0)"),
                       lambda acc, x: (acc * x).cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(F.length(F.trim(mask)) == 0, zero).when(log10_capacity_col(mask) < 37.9, prod)


def id_length_col(mask: Column, prefix: Column, suffix: Column) -> Column:
    """Length of the IDs a mask produces (only known letters emit a symbol)."""
    m = F.lower(F.trim(mask))
    return F.length(prefix) + F.length(F.regexp_replace(m, "[^dluc]", "")) + F.length(suffix)


# --- Draws -------------------------------------------------------------------

NARROW_CAPACITY = 1 << 50
GROUP_LETTERS = 8


def letter_groups(mask: str) -> list[str]:
    """The mask's letters in groups that are drawn from one hash each; one group below 2^50 IDs."""
    letters = "".join(ch for ch in normalise(mask) if ch in model.MASK_ALPHABETS)
    if capacity(letters) < NARROW_CAPACITY:
        return [letters]
    return [letters[i:i + GROUP_LETTERS] for i in range(0, len(letters), GROUP_LETTERS)]


def draw_code(draw: Column, secret: str, cap: int, group: int = 0) -> Column:
    """Keyed draw: first 15 hex digits (60 bits) of sha256(secret || draw [|| '/' group]) mod cap."""
    parts = [F.lit(secret), draw.cast("string")] + ([F.lit(f"/{group}")] if group else [])
    h = F.sha2(F.concat(*parts), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint") % F.lit(cap)


def draw_id(draw: Column, secret: str, mask: str, prefix: str = "", suffix: str = "") -> Column:
    """The ID of a draw, for masks of any length."""
    parts = [decode_code(draw_code(draw, secret, capacity(letters), g), letters)
             for g, letters in enumerate(letter_groups(mask))]
    return F.concat(F.lit(prefix), *parts, F.lit(suffix))


def decode_code(code: Column, mask: str, prefix: str = "", suffix: str = "") -> Column:
    """Mixed-radix decode of a code number into an ID following ``mask``.

    The last mask letter is the least significant digit. Digits are taken as
    ``(code % (w * size) - code % w) / w``: an exact multiple divided by w, so
    the double division is exact.
    """
    letters = [ch for ch in normalise(mask) if ch in model.MASK_ALPHABETS]
    parts = []
    weight = 1
    for ch in reversed(letters):
        alphabet = model.MASK_ALPHABETS[ch]
        upper = weight * len(alphabet)
        digit = ((code % F.lit(upper)) - (code % F.lit(weight))) / F.lit(weight)
        parts.append(F.substr(F.lit(alphabet), (digit + 1).cast("int"), F.lit(1)))
        weight = upper
    parts.reverse()
    return F.concat(F.lit(prefix), *parts, F.lit(suffix))
