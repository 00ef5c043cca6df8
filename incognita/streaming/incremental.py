"""Incremental de-identification of a drop folder of header tables.

A Structured Streaming file source picks up new header Parquet files; each
micro-batch runs the batch job (``plans.jobs.deidentify``) against the same
registry. State between batches is the registry itself: a study seen in an
earlier batch is found by lookup and keeps its ID; a new one takes the next
free slot. A replayed batch (same batch id after a failure) finds its studies
already committed and rewrites the same (root, run_id) partitions.

The checkpoint location is the stream's identity: a restart with the same one
goes on after the last batch, and run IDs hold the stream's own ID, so another
stream over the same output never replaces its batches.

No watermark is needed: a late file of a known study gets its ID by lookup.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from incognita import model
from incognita.plans import jobs


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The ID that Spark gave the stream when it first started with this checkpoint location."""
    text = spark.read.text(f"{checkpoint_location.rstrip('/')}/metadata", wholetext=True).first()[0]
    return json.loads(text)["id"]


def start(spark: SparkSession, headers_dir: str, registry_root: str, out_dir: str,
          checkpoint_location: str, available_now: bool = True,
          max_files_per_trigger: int | None = None, user: str = "", computer: str = "") -> StreamingQuery:
    if not checkpoint_location:
        raise ValueError("a stream needs a checkpoint location of its own, on storage that outlives the session")
    reader = spark.readStream.schema(model.HEADERS).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(headers_dir)

    def run_batch(batch, batch_id: int) -> None:
        own = batch.sparkSession
        run_id = f"{stream_id(own, checkpoint_location)[:8]}-b{batch_id:08d}"
        jobs.deidentify(own, batch, registry_root, out_dir, run_id=run_id, user=user, computer=computer, inputs=[headers_dir])

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
