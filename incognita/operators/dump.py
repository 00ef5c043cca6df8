"""Header dump: one text rendering of all elements of a file, in preorder.

An element is printed with its name: the words of its keyword, but for the few
names of ``model.ELEMENT_NAMES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.tags import depth_of, is_private, tag_of
from incognita.operators.screen import file_name

LINE_FORMAT = "(%04X,%04X) %-35s %s: %s"
INDENT = "  "
PRIVATE_LABEL = "Private tag data"
UNKNOWN_LABEL = "Unknown tag"
MSG_FAILED = ": no header dump: "


def element_name(keyword: Column) -> Column:
    """StudyInstanceUID -> Study Instance UID, PatientName -> Patient's Name."""
    words = F.regexp_replace(F.regexp_replace(keyword, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    for k, name in model.ELEMENT_NAMES.items():
        words = F.when(keyword == k, F.lit(name)).otherwise(words)
    return words


def label(e: Column) -> Column:
    t = tag_of(e)
    return F.when(F.coalesce(e["keyword"], F.lit("")) != "", element_name(e["keyword"])) \
        .when(is_private(t), F.lit(PRIVATE_LABEL)).otherwise(F.lit(UNKNOWN_LABEL))


def line(e: Column) -> Column:
    t = tag_of(e)
    body = F.format_string(LINE_FORMAT, F.shiftright(t, 16), t.bitwiseAND(0xFFFF), label(e), e["vr"],
                           F.coalesce(e["value"], F.lit("")))
    return F.concat(F.repeat(F.lit(INDENT), depth_of(e)), body)


def header_text(elements: Column | str = "elements") -> Column:
    c = F.col(elements) if isinstance(elements, str) else elements
    return F.array_join(F.transform(c, line), "\n")


def header_dump(headers: DataFrame) -> DataFrame:
    """(path, out_path, text) for every readable file; see ``failures`` for the others."""
    ok = headers.where(F.col("parse_error").isNull())
    return ok.select("path", F.concat("path", F.lit(".hdr.txt")).alias("out_path"),
                     header_text().alias("text"))


def failures(headers: DataFrame) -> DataFrame:
    """(path, message) of the files that could not be dumped."""
    bad = headers.where(F.col("parse_error").isNotNull())
    return bad.select("path", F.concat(file_name("path"), F.lit(MSG_FAILED), F.col("parse_error")).alias("message"))
