"""Hand-built header rows for unit tests."""

from pyspark.sql import Row

from incognita import model
from incognita.functions.tags import with_keys


def el(pos, keyword, vr, value):
    """Element from a preorder position (tag, item, tag, ..., tag)."""
    pos = [int(p) for p in pos]
    return Row(pos=pos, path_tags=pos[0::2], keyword=keyword, vr=vr, value=value)


BASE = ("path string, root string, root_ord int, mtime timestamp, magic string, parse_error string, "
        "elements array<struct<pos:array<bigint>,path_tags:array<bigint>,keyword:string,vr:string,value:string>>")


def header(path, elements, root="r0", root_ord=0, magic="DICM", parse_error=None):
    return (path, root, root_ord, None, magic, parse_error, elements)


def frame(spark, rows):
    """Header rows in the stored schema: key columns derived from the elements."""
    return with_keys(spark.createDataFrame(rows, BASE))


T = model.tag
