"""Column expressions over tags and element arrays (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita import model


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_private(t: Column) -> Column:
    """Private tags have an odd group number."""
    return F.shiftright(t, 16).bitwiseAND(1) == 1


def is_curve(t: Column) -> Column:
    """Curve groups 0x5000-0x50FF."""
    return F.shiftright(t, 16).bitwiseAND(model.CURVE_GROUP_MASK) == model.CURVE_GROUP_VALUE


def tag_of(e: Column) -> Column:
    """Tag of an element struct (last entry of its tag path)."""
    return F.element_at(e["path_tags"], -1)


def depth_of(e: Column) -> Column:
    return F.size(e["path_tags"]) - 1


def is_top(e: Column) -> Column:
    return F.size(e["path_tags"]) == 1


def top_element(elements: Column | str, t: int) -> Column:
    """The top-level element with tag ``t``, or NULL when absent.

    ``get`` returns NULL for a missing index even in ANSI mode.
    """
    return F.get(F.filter(col(elements), lambda e: is_top(e) & (e["path_tags"][0] == F.lit(t))), 0)


def top_value(elements: Column | str, t: int, default: str | None = None) -> Column:
    """Safe read of a top-level value: the value, or ``default`` when absent."""
    v = top_element(elements, t)["value"]
    return F.coalesce(v, F.lit(default)) if default is not None else v


def first_value_anywhere(elements: Column | str, t: int) -> Column:
    """Value of the first element with tag ``t`` in preorder, at any depth."""
    return F.get(F.filter(col(elements), lambda e: tag_of(e) == F.lit(t)), 0)["value"]


def has_top(elements: Column | str, t: int) -> Column:
    return F.exists(col(elements), lambda e: is_top(e) & (e["path_tags"][0] == F.lit(t)))


def element(pos: Column, path_tags: Column, keyword: Column, vr: Column, value: Column) -> Column:
    return F.struct(pos.alias("pos"), path_tags.alias("path_tags"), keyword.alias("keyword"),
                    vr.alias("vr"), value.alias("value"))


def explode_elements(headers, *keep: str):
    """One row per element: ``keep`` columns plus top_tag, item, tag, keyword, vr, value.

    ``item`` is -1 at top level, else the item number directly under the
    top-level sequence (deeper positions stay in ``pos``).
    """
    rows = headers.select(*keep, F.inline("elements"))
    return rows.select(
        *keep,
        F.col("pos")[0].alias("top_tag"),
        F.when(F.size("pos") > 1, F.col("pos")[1]).otherwise(F.lit(-1).cast("bigint")).alias("item"),
        F.element_at("pos", -1).alias("tag"),
        "keyword", "vr", "value",
    )


def key_values(elements: Column | str = "elements") -> dict[str, Column]:
    """Key column expressions: first StudyInstanceUID in preorder, top-level identifiers."""
    out = {"study_uid": first_value_anywhere(elements, model.STUDY_INSTANCE_UID),
           "top_study_uid": top_value(elements, model.STUDY_INSTANCE_UID)}
    out.update({c: top_value(elements, t) for c, t in model.KEY_TAGS.items()})
    return out


def with_keys(headers):
    """Add (or refresh) the key columns from ``elements``; run when writing a header table."""
    keys = key_values("elements")
    rest = [c for c in headers.columns if c not in keys and c != "elements"]
    return headers.select(*rest, *[v.alias(k) for k, v in keys.items()], "elements")


def key_column(df, name: str) -> Column:
    """A key column if the table has it, else the expression over ``elements``."""
    return F.col(name) if name in df.columns else key_values("elements")[name]
