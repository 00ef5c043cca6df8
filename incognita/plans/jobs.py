"""Jobs that write: registry creation, batch de-identification, dumps and edits.

De-identification commits the registry before it writes any output:

  1. load registry version N (checked: no gaps, no duplicate UIDs)
  2. plan the run; the new studies' slots are computed deterministically
  3. write registry version N+1 (the assignments are now durable)
  4. re-plan against N+1: every study is known, files get IDs by lookup
  5. write de-identified headers partitioned by (root, run_id) with dynamic
     partition overwrite, so a rerun or a replayed batch replaces, never duplicates
  6. write the outcome table, commit the output (its rows are current from here on)
     and append the audit log

If the job dies after 3, the rerun finds the studies in the registry and
reuses their IDs; if it dies before 3, nothing was assigned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import dump, idpool, patch, pixels, report, screen, tiles
from incognita.operators import registry_ops as reg
from incognita.operators.scrub import DEFAULT_RULES, Rules
from incognita.plans import deidentify as deid
from incognita.sources import buckets
from incognita.sources import files as raw_files
from incognita.sources import output, processed
from incognita.sources import registry as store
from incognita.sources.headers import ensure_keys, write_header_table


@dataclass
class RunResult:
    run_id: str
    registry_version: int
    new_studies: int
    exhausted_studies: int
    report: list[dict]


def open_registry(spark: SparkSession, root: str, check: bool = True) -> store.Registry | buckets.BucketRegistry:
    """The latest version of a registry in either layout."""
    return buckets.load(spark, root) if buckets.is_bucketed(spark, root) else store.load(spark, root, check)


def _slots(registry: store.Registry | buckets.BucketRegistry) -> DataFrame:
    return registry.slots() if isinstance(registry, buckets.BucketRegistry) else registry.slots


def create_study(spark: SparkSession, registry_root: str, title: str, pi: str, request: idpool.PoolRequest, user: str = "",
                 computer: str = "", bucketed: bool = False) -> store.Registry | buckets.BucketRegistry:
    """Generate the ID pool and write a new registry (front, slots v1, log); ``bucketed`` for registries of many millions of studies."""
    req = request.checked()
    pool = idpool.generate(spark, req)
    slots = idpool.empty_slots(pool)
    lines = [model.MSG_STUDY_CREATED.format(title=title, pi=pi),
             model.MSG_POOL_CREATED.format(n=req.n, prefix=req.prefix, mask=req.mask, suffix=req.suffix)]
    lines += idpool.warnings(req)
    make = buckets.create if bucketed else store.create
    return make(spark, registry_root, title, pi, slots, req.n, user=user, computer=computer,
                        creation_messages=lines)


def extend_study(spark: SparkSession, registry_root: str, request: idpool.PoolRequest, user: str = "",
                 computer: str = "") -> store.Registry | buckets.BucketRegistry:
    """Add ``request.n`` study IDs to a registry; its pool size becomes that of all its slots."""
    req = request.checked()
    registry = open_registry(spark, registry_root)
    slots = _slots(registry)
    last = max(reg.registry_stats(slots, int(registry.front["n_study_ids"])).max_row, 1)
    more = idpool.empty_slots(idpool.extend(spark, slots, req, last + 1))
    if isinstance(registry, buckets.BucketRegistry):
        registry = registry.extend(more, last + req.n - 1)
    else:
        registry = store.commit(spark, registry, slots.unionByName(more), n_study_ids=last + req.n - 1)
    line = model.MSG_POOL_CREATED.format(n=req.n, prefix=req.prefix, mask=req.mask, suffix=req.suffix)
    store.append_log(spark, registry_root, [(model.LOG_NORMAL, line)], user, computer)
    return registry


def _plan(headers: DataFrame, registry: store.Registry | buckets.BucketRegistry, rules: Rules, committed: deid.Run | None = None) -> deid.Run:
    if isinstance(registry, buckets.BucketRegistry):
        return deid.plan(headers, None, registry.front, rules, committed, registry)
    return deid.plan(headers, registry.slots, registry.front, rules, committed)


def deidentify(spark: SparkSession, headers: DataFrame, registry_root: str, out_dir: str, run_id: str,
               rules: Rules = DEFAULT_RULES, user: str = "", computer: str = "",
               log_level: int = model.LOG_NORMAL, inputs: list[str] | None = None,
               screened: DataFrame | None = None, only_changed: bool = False) -> RunResult:
    """De-identify the files of a header table. ``inputs`` names them in the launch line;
    ``screened`` are files (path, root, outcome, message) that were left out before parsing.
    ``only_changed`` leaves out files that another run finished in this version
    under these rules. A run that fails leaves a closing line that says so."""
    try:
        return _deidentify(spark, headers, registry_root, out_dir, run_id, rules, user, computer, log_level, inputs, screened, only_changed)
    except Exception as exc:
        if store.exists(spark, registry_root):
            store.append_log(spark, registry_root, [(model.LOG_NORMAL, f"Run {run_id} failed: {type(exc).__name__}")], user, computer)
        raise


def _deidentify(spark: SparkSession, headers: DataFrame, registry_root: str, out_dir: str, run_id: str, rules: Rules, user: str,
                computer: str, log_level: int, inputs: list[str] | None, screened: DataFrame | None, only_changed: bool) -> RunResult:
    out_dir = out_dir.rstrip("/")
    headers = ensure_keys(headers)
    digest = processed.rules_digest(rules)
    done = processed.read(spark, out_dir) if only_changed else None
    if done is not None:
        headers = processed.only_todo(headers, done.where(F.col("run_id") != run_id), digest)
    registry = open_registry(spark, registry_root)
    in_buckets = isinstance(registry, buckets.BucketRegistry)
    store.append_log(spark, registry_root,
                     [(model.LOG_NORMAL, model.MSG_LAUNCHED.format(inputs=", ".join(inputs or [f"run {run_id}"])))], user, computer)

    first = _plan(headers, registry, rules)
    fresh = first.assigned.where(F.col("study_id").isNotNull())
    counts = first.assigned.agg(F.count(F.lit(1)).alias("n"),
                                   F.count(F.when(F.col("study_id").isNull(), 1)).alias("x")).first()
    if counts["n"] > counts["x"]:
        if in_buckets:
            registry = registry.commit(first.assignments)
        else:
            registry = store.commit_changes(spark, registry, reg.changed_slots(registry.slots, first.assignments, bound=first.n_studies))
        events = fresh.select(F.current_timestamp().alias("ts"), F.col("study_uid").alias("ord"),
                              F.lit(model.LOG_NORMAL).alias("level"),
                              F.concat(F.lit("Assigned "), F.col("study_id"), F.lit(" to a new study"),
                                       F.when(F.col("over_pool"), F.lit(" (slot past the declared pool size)"))
                                       .otherwise(F.lit(""))).alias("message"))
        if log_level >= model.LOG_NORMAL:
            start = store.reserve(spark, registry_root, counts["n"] - counts["x"])
            log = report.audit_log(events, log_level, start, user, computer)
            store.append_log_frame(registry_root, log.withColumn("ts", F.current_timestamp()))

    # Second pass against the committed version: lookups only, no study pass.
    run = _plan(headers, registry, rules, committed=first)
    output.write(out_dir, run.output, run_id)
    outcomes = run.outcomes.select("path", "root", "study_uid", "outcome", "message")
    if screened is not None:
        outcomes = outcomes.unionByName(screened.select("path", "root", F.lit(None).cast("string").alias("study_uid"), "outcome", "message"))
    (outcomes.withColumn("run_id", F.lit(run_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(f"{out_dir}/outcomes"))
    rep = [r.asDict() for r in deid.run_report(
        output.read_outcomes(spark, out_dir).where(F.col("run_id") == run_id)).collect()]  # one row per root
    output.remove_stale(spark, out_dir, run_id, [r["root"] for r in rep if not r["is_total"] and r["n_anonymised"]])
    output.commit(spark, out_dir, run_id)
    finished = run.outcomes.where(F.col("outcome") != screen.EXHAUSTED).select("path", "mtime")
    processed.record(out_dir, finished, digest, run_id)
    total = next((r for r in rep if r["is_total"]), {})
    store.append_log(spark, registry_root, [(model.LOG_NORMAL, model.MSG_COMPLETED.format(
        ok=total.get("n_anonymised", 0), failed=total.get("n_exhausted", 0)))], user, computer)
    return RunResult(run_id, registry.version, int(counts["n"] - counts["x"]), int(counts["x"]), rep)


def deidentify_roots(spark: SparkSession, roots: list[str], headers: DataFrame, registry_root: str, out_dir: str,
                     run_id: str, **options) -> RunResult:
    """From raw root folders to outcomes: screen the files, then de-identify those with a header row.

    ``headers`` is the header table that the parser made of the candidates (paths
    as in ``sources.files.inventory``). Files on the skip list and files without
    the magic bytes enter the run's outcomes and report; so do candidates without
    a header row, as unreadable ones.
    """
    found = raw_files.with_magic(spark, roots)
    counts = raw_files.dir_counts(found).where("root is null").first()
    store.append_log(spark, registry_root, [(model.LOG_HIGH, f"Found {counts['n_files']} files in {counts['n_dirs']} folders")],
                     options.get("user", ""), options.get("computer", ""))
    # Files with a header row are screened again by the run itself; only paths are joined here.
    listed = screen.prescreen(found).join(headers.select("path"), "path", "left_anti")
    unparsed = F.col("outcome") == screen.CANDIDATE
    screened = listed.select("path", "root", F.when(unparsed, F.lit(screen.UNREADABLE)).otherwise(F.col("outcome")).alias("outcome"),
                             F.when(unparsed, F.concat(screen.file_name("path"), F.lit(screen.MSG_UNREADABLE)))
                             .otherwise(F.col("message")).alias("message"))
    return deidentify(spark, headers, registry_root, out_dir, run_id, inputs=roots, screened=screened, **options)


def apply_edits(spark: SparkSession, headers: DataFrame, patches: DataFrame, out_dir: str, key: str = "patient_id",
                order: str | None = None, fields: dict[str, tuple[int, str, str]] = patch.EDIT_FIELDS) -> dict:
    """Write the header table with the patches applied and its key columns derived anew."""
    return _save_edits(spark, headers, patch.apply_patches(ensure_keys(headers), patches, fields, key, order), "has_patch", out_dir)


def set_tags(spark: SparkSession, headers: DataFrame, patches: DataFrame, tag: int, out_dir: str, key: str = "patient_id",
             order: str | None = None, value_col: str = "new_value", active: str | None = None) -> dict:
    """Write the header table with one tag changed where a file has it."""
    edited = patch.set_existing(ensure_keys(headers), patches, tag, value_col, key, order, active)
    return _save_edits(spark, headers, edited.withColumn("has_patch", F.col("status") == "set"), "has_patch", out_dir)


def _save_edits(spark: SparkSession, headers: DataFrame, edited: DataFrame, flag: str, out_dir: str) -> dict:
    watch = Observation()
    edited = edited.observe(watch, F.count(F.lit(1)).alias("n_files"), F.count_if(F.col(flag)).alias("n_edited"))
    write_header_table(edited.drop(*model.KEY_COLUMNS, "elements").withColumnRenamed("patched", "elements"), out_dir)
    return {k: int(v) for k, v in watch.get.items()}


def compare_pixels(spark: SparkSession, pairs_dir: str, out_dir: str) -> dict:
    """Compare a stored table of image pairs: statistics by pair and the pixels that differ."""
    pairs = spark.read.schema(model.PIXEL_PAIRS).parquet(pairs_dir)
    out_dir = out_dir.rstrip("/")
    pixels.pixel_compare(pairs).write.mode("overwrite").parquet(f"{out_dir}/stats")
    pixels.pixel_diff(pairs).write.mode("overwrite").parquet(f"{out_dir}/diff")
    return _pixel_counts(spark, out_dir)


def compare_tiles(spark: SparkSession, before_dir: str, after_dir: str, out_dir: str) -> dict:
    """Compare two stored tile tables (``operators.tiles.cut``): statistics by pair and the pixels that differ."""
    before, after = (spark.read.schema(model.TILES).parquet(d) for d in (before_dir, after_dir))
    out_dir = out_dir.rstrip("/")
    tiles.tile_stats(before, after).write.mode("overwrite").parquet(f"{out_dir}/stats")
    tiles.tile_diff(before, after).write.mode("overwrite").parquet(f"{out_dir}/diff")
    return _pixel_counts(spark, out_dir)


def _pixel_counts(spark: SparkSession, out_dir: str) -> dict:
    r = spark.read.parquet(f"{out_dir}/stats").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("pixels_equal").alias("n_equal"),
                                                    F.sum("n_mismatch").alias("n_mismatch")).first()
    return {k: int(r[k] or 0) for k in ("n_pairs", "n_equal", "n_mismatch")}


def header_dump(headers: DataFrame, out_dir: str) -> None:
    """One text rendering per readable file, stored as a table (path, out_path, text).

    Millions of tiny .txt files are an object-store anti-pattern; a consumer
    that needs real files can write them from this table. Files that could not be
    read are listed in ``<out_dir>-failures`` (path, message).
    """
    dump.header_dump(headers).write.mode("overwrite").parquet(out_dir)
    dump.failures(headers).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}-failures")


def reidentify(spark: SparkSession, deidentified_dir: str, registry_root: str) -> DataFrame:
    """Pseudonym -> original patient and study, through the registry only."""
    slots = _slots(open_registry(spark, registry_root, check=False))
    files = output.read(spark, deidentified_dir).select("path", "study_id", "root", "run_id")
    return reg.reidentify(files, slots, max(slots.count(), 1))


def reidentify_ids(spark: SparkSession, ids: DataFrame, registry_root: str) -> DataFrame:
    """Original patient and study of the pseudonyms in ``ids`` (study_id).

    Of a registry in buckets only the index files that may hold one of them are read.
    """
    registry = open_registry(spark, registry_root, check=False)
    wanted = ids.select("study_id").distinct()
    held = registry.find("by_id", wanted) if isinstance(registry, buckets.BucketRegistry) else registry.slots.join(wanted, "study_id", "left_semi")
    return held.where(reg.assigned()).select("study_id", F.col("patient_id").alias("original_patient_id"), F.col("study_uid").alias("original_study_uid"))
