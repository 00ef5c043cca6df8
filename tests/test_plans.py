"""Physical plan properties: scrubs are narrow and JVM-only, scans are pruned."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from incognita.operators import scrub, screen
from incognita.plans import deidentify as deid
from incognita.sources import fixtures as fx


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_headers(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="incognita-plan-") + "/headers"
    fx.build_headers(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_scrub_is_narrow_and_has_no_python(stored_headers):
    out = stored_headers.select("path", scrub.scrub("elements").alias("elements"))
    p = plan_text(out)
    assert "Exchange" not in p
    assert "PythonUDF" not in p and "EvalPython" not in p


def test_screening_prunes_columns(stored_headers):
    df = screen.tag_warnings(screen.classify(stored_headers))
    p = plan_text(df)
    read_schema = p[p.index("ReadSchema"):].split("\n")[0] if "ReadSchema" in p else ""
    df.explain()
    assert "mtime" not in read_schema and "root_ord" not in read_schema


def test_files_side_never_shuffles(spark, stored_headers):
    front = fx.study_front(spark, SF_SMALL).first().asDict()
    run = deid.plan(stored_headers, fx.pool(spark, SF_SMALL), front)
    p = plan_text(run.output)
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p


def test_outcome_filter_is_pushed_to_scan(spark, stored_headers):
    df = stored_headers.where(F.col("parse_error").isNull()).select("path")
    assert "PushedFilters: [IsNull(parse_error)]" in plan_text(df)
