import json

import pytest


@pytest.fixture
def table(spark):
    """A DataFrame from tuples and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def small_docs(spark):
    """Documents with the awkward cases: nulls, empty, repeated rows, ties, a very long text, extra columns."""
    long = " ".join(f"word{i % 997} the" for i in range(60_000))
    rows = [(0, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 1),
            (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n  ", "en", None, 6), (4, long, "en", "b", len(long)),
            (0, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 1),
            (None, "Kein Schlüssel passt in dieses Schloß, sagte der alte Mann leise.", "de", "c", 3),
            (7, "123 456 !!!", None, "c", 3), (8, "Kein Schlüssel passt in dieses Schloß, sagte der alte Mann leise.", "de", "c", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain(row):
    return json.loads(json.dumps(row.asDict(True), default=str))
