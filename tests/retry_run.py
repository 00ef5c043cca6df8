"""Run the de-identification plan with task failures injected (used by test_retries).

The first attempt of partition 1 fails in every stage that reads the header
table; Spark retries the task. The output must equal a clean run's.
"""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from incognita.plans import deidentify as deid  # noqa: E402
from incognita.sources import fixtures as fx  # noqa: E402


MARKERS = tempfile.mkdtemp(prefix="incognita-retry-markers-")


@F.pandas_udf(T.StringType())
def flaky(path: pd.Series) -> pd.Series:
    ctx = TaskContext.get()
    if ctx is not None and ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
        open(os.path.join(MARKERS, f"stage{ctx.stageId()}-p1"), "w").close()  # local mode: one machine
        raise RuntimeError("injected task failure")
    return path


def main(sf_dir):
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="incognita-retry-"))
    headers = fx.headers(spark, sf_dir).repartition(4)
    slots = fx.pool(spark, sf_dir)
    front = fx.study_front(spark, sf_dir).first().asDict()

    def ids(h):
        run = deid.plan(h, slots, front)
        return sorted((r.path, r.study_id, len(r.elements)) for r in run.output.collect())

    clean = ids(headers)
    failing = ids(headers.withColumn("path", flaky("path")))
    print(json.dumps({"equal": clean == failing, "rows": len(clean), "failures": len(os.listdir(MARKERS))}))


if __name__ == "__main__":
    main(sys.argv[1])
