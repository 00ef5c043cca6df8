"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each one reads the driver's tables (through the fixtures of FIXTURES.md) and
runs the engine's operators over all of them. Column names equal those of
the matching DuckDB oracle in ``incognita.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.functions import masks
from incognita.functions.tags import explode_elements, top_value
from incognita.operators import dump, idpool, patch, pixels, report, screen, tiles
from incognita.operators import registry_ops as reg
from incognita.operators import scrub as scrub_ops
from incognita.operators.scrub import output_path
from incognita.plans import deidentify as deid
from incognita.plans import jobs
from incognita.session import ensure_checkpoint_dir
from incognita.sources import buckets
from incognita.sources import files as raw_files
from incognita.sources import fixtures as fx
from incognita.sources import output, processed
from incognita.sources import registry as registry_store
from incognita.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _front(spark: SparkSession, sf_dir: str) -> dict:
    return fx.memo(spark, sf_dir, "front_row", lambda: fx.study_front(spark, sf_dir).first().asDict())


def fixture_run(spark: SparkSession, sf_dir: str, slots: DataFrame | None = None) -> deid.Run:
    headers = fx.headers(spark, sf_dir)
    slots = fx.pool(spark, sf_dir) if slots is None else slots
    return deid.plan(headers, slots, _front(spark, sf_dir))


@query
def q_deidentify(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return explode_elements(run.output, "path", "out_path", "study_id")


# ---- scan, screening ---------------------------------------------------------

def _classified(spark, sf_dir):
    return screen.classify(fx.derived_headers(spark, sf_dir))  # its readers take key columns alone


@query
def q_scan_inventory(spark, sf_dir):
    h = fx.headers(spark, sf_dir).select("root", screen.parent_dir("path").alias("dir"))
    return h.groupBy("root").agg(F.count(F.lit(1)).alias("n_files"),
                                 F.countDistinct("dir").alias("n_dirs"))


@query
def q_scan_tree(spark, sf_dir):
    """Real trees of files, one per event: listed by executors, heads read, screened before any parsing."""
    root = F.regexp_extract("root", r"([^/]*)$", 1)
    of = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in (screen.SKIPLIST, screen.NOT_DICOM, screen.CANDIDATE)]
    counts, schema = [], None
    for roots in fx.trees(spark, sf_dir):
        found = screen.prescreen(raw_files.with_magic(spark, roots))
        part = found.groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(screen.parent_dir("path")).alias("n_dirs"),
                                                     F.sum("length").alias("n_bytes"), *of)
        schema = part.schema
        counts += part.collect()  # a row per root; a folder lies in one tree only
    return spark.createDataFrame(counts, schema).groupBy("root").agg(*[F.sum(n).alias(n) for n in schema.names[1:]])


@query
def q_output_path(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("path", output_path().alias("out_path"))


@query
def q_file_outcomes(spark, sf_dir):
    return _classified(spark, sf_dir).select("path", "root", "outcome", "message")


@query
def q_tag_warnings(spark, sf_dir):
    return screen.tag_warnings(_classified(spark, sf_dir))


@query
def q_study_uid(spark, sf_dir):
    h = fx.headers(spark, sf_dir)
    return h.select("path", screen.study_uid().alias("study_uid")).where(F.col("study_uid").isNotNull())


@query
def q_header_pivot(spark, sf_dir):
    h = fx.headers(spark, sf_dir)
    return h.select("path", *[F.coalesce(F.col(k), F.lit(reg.NIL)).alias(c) for c, k in PIVOT_KEYS.items()])


# Safe top-level reads (absent -> 'Nil') served from the key columns.
PIVOT_KEYS = {
    "patient_name": "patient_name", "patient_id": "patient_id", "accession_number": "accession_number",
    "study_date": "study_date", "study_time": "study_time", "study_uid": "top_study_uid",
    "study_description": "study_description",
}


# ---- scrub rules, each alone -------------------------------------------------

def _scrubbed(spark, sf_dir, expr):
    h = fx.headers(spark, sf_dir).select("path", expr.alias("elements"))
    return explode_elements(h, "path")


@query
def q_scrub_private(spark, sf_dir):
    return _scrubbed(spark, sf_dir, scrub_ops.drop_private("elements"))


@query
def q_scrub_curves(spark, sf_dir):
    return _scrubbed(spark, sf_dir, scrub_ops.drop_curves("elements"))


@query
def q_scrub_sequence(spark, sf_dir):
    return _scrubbed(spark, sf_dir, scrub_ops.drop_tags("elements", [model.REQUEST_ATTRIBUTES_SEQUENCE]))


@query
def q_scrub_vr(spark, sf_dir):
    return _scrubbed(spark, sf_dir, scrub_ops.replace_by_vr("elements"))


@query
def q_scrub_fixed(spark, sf_dir):
    return _scrubbed(spark, sf_dir, scrub_ops.upsert_top_level(
        "elements", model.FIXED_ASSIGNMENTS, F.lit(model.DEFAULT_PATIENT_ID), F.lit(model.DEFAULT_PATIENT_NAME)))


# ---- registry ----------------------------------------------------------------

def _ok_files(spark, sf_dir):
    return _classified(spark, sf_dir).where(F.col("outcome") == screen.OK)


def _new_studies(spark, sf_dir):
    """Studies of ok files that the fixture registry does not know (no assignment step)."""
    index = reg.registry_index(fx.pool(spark, sf_dir))
    return reg.new_studies(reg.study_firsts(_ok_files(spark, sf_dir)), index)


@query
def q_study_new(spark, sf_dir):
    return _new_studies(spark, sf_dir).select("study_uid", F.col("path").alias("first_path"))


@query
def q_study_lookup(spark, sf_dir):
    slots = fx.pool(spark, sf_dir)
    stats = reg.registry_stats(slots, int(_front(spark, sf_dir)["n_study_ids"]))
    ok = _ok_files(spark, sf_dir).select("path", "study_uid")
    idx = reg.registry_index(slots).select("study_uid", "row_no", "study_id")
    return reg.lookup(ok, idx, stats.bound).select("path", "study_uid", "row_no", "study_id")


ASSIGN_COLS = ["study_uid", "k", "row_no", "study_id", "over_pool", "patient_name", "patient_id",
               "accession_number", "study_date", "study_time", "study_description"]


@query
def q_study_assign(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return run.assignments.select(*ASSIGN_COLS, F.col("path").alias("first_path"))


@query
def q_first_free_slot(spark, sf_dir):
    front = _front(spark, sf_dir)
    return reg.first_free_slot(fx.pool(spark, sf_dir), int(front["n_study_ids"]))


@query
def q_registry_index(spark, sf_dir):
    return reg.registry_index(fx.pool_dup(spark, sf_dir)).select("study_uid", "row_no", "study_id")


@query
def q_registry_check(spark, sf_dir):
    front = _front(spark, sf_dir)
    return registry_store.check_slots(fx.pool_gap(spark, sf_dir), int(front["n_study_ids"]))


COMMIT_COLS = ["row_no", "study_id", "patient_id", "study_uid", "patient_name", "accession_number",
               "study_date", "study_time", "study_description"]


@query
def q_registry_commit(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    return reg.commit(fx.pool(spark, sf_dir), run.assignments, bound=run.n_studies).select(*COMMIT_COLS)


@query
def q_reidentify(spark, sf_dir):
    run = fixture_run(spark, sf_dir)
    committed = reg.commit(fx.pool(spark, sf_dir), run.assignments, bound=run.n_studies)
    files = run.output.select("path", "study_id")
    return reg.reidentify(files, committed, run.stats.bound).select(
        "path", "study_id", "original_patient_id", "original_study_uid")


INCREMENTAL_CUTOFF = "2024-01-16 00:00:00"


@query
def q_incremental_assign(spark, sf_dir):
    """Two runs against one registry: files up to the cutoff, then all files."""
    headers = fx.headers(spark, sf_dir)
    early = headers.where(F.col("mtime") < F.lit(INCREMENTAL_CUTOFF).cast("timestamp"))
    front = _front(spark, sf_dir)
    slots0 = fx.pool(spark, sf_dir)
    run1 = deid.plan(early, slots0, front)
    a1 = run1.assignments.checkpoint()  # materialised, as a committed registry version would be
    slots1 = reg.commit(slots0, a1, bound=run1.n_studies)
    run2 = deid.plan(headers, slots1, front)
    a2 = run2.assignments
    cols = ["study_uid", "row_no", "study_id"]
    return a1.select(*cols, F.lit(1).alias("run")).unionByName(a2.select(*cols, F.lit(2).alias("run")))


@query
def q_incremental_files(spark, sf_dir):
    """What a rerun takes: files of after the cutoff, and earlier ones that changed since (every seventh user's)."""
    headers = fx.headers(spark, sf_dir)
    rules = processed.rules_digest(scrub_ops.DEFAULT_RULES)
    old = F.regexp_extract("path", r"/p(\d+)/", 1).cast("bigint") % 7 == 0
    done = headers.where(F.col("mtime") < F.lit(INCREMENTAL_CUTOFF).cast("timestamp")).select(
        "path", F.when(old, F.col("mtime") - F.expr("interval 1 hour")).otherwise(F.col("mtime")).alias("mtime"), F.lit(rules).alias("rules"),
        F.lit("2024-02-01").cast("timestamp").alias("recorded_at"), F.lit("r1").alias("run_id"))
    return processed.todo(headers, done, rules)


@query
def q_output_current(spark, sf_dir):
    """Current versions after three committed runs: early files, every seventh user's and later ones, and the first run's again for one root."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/output-{uuid.uuid4().hex}"
    files = fx.derived_headers(spark, sf_dir).select("path", output_path().alias("out_path"), F.col("study_uid").alias("study_id"), "elements", "root", "mtime")
    early = F.col("mtime") < F.lit(INCREMENTAL_CUTOFF).cast("timestamp")
    seventh = F.regexp_extract("path", r"/p(\d+)/", 1).cast("bigint") % 7 == 0
    for run_id, taken in (("r1", early), ("r2", ~early | seventh), ("r3", early & (F.col("root") == "root1"))):
        output.write(out, files.where(taken).drop("mtime"), run_id)
        output.commit(spark, out, run_id)
    return output.read(spark, out).select("path", "out_path", "run_id", F.size("elements").cast("bigint").alias("n_elements"))


def _bucket_registry(spark, sf_dir) -> buckets.BucketRegistry:
    """The fixture registry in buckets, in a folder of its own."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    front = _front(spark, sf_dir)
    return buckets.create(spark, root, front["study_title"], front["pi"], fx.pool(spark, sf_dir), int(front["n_study_ids"]), buckets=16, segment_rows=4096)


@query
def q_registry_buckets(spark, sf_dir):
    """The two runs of ``incremental_assign`` against a stored registry in buckets, committed in between."""
    headers = fx.derived_headers(spark, sf_dir)
    early = headers.where(F.col("mtime") < F.lit(INCREMENTAL_CUTOFF).cast("timestamp"))
    registry = _bucket_registry(spark, sf_dir)
    out = []
    for n, files in enumerate((early, headers), 1):
        run = deid.plan(files, None, registry.front, source=registry)
        registry = registry.commit(run.assignments)
        mine = registry.find("by_uid", run.assigned.select("study_uid")).select("study_uid", "row_no", "study_id")
        none = run.assigned.where("study_id is null").select("study_uid", "row_no", "study_id")  # the pool was exhausted
        out.append(mine.unionByName(none).withColumn("run", F.lit(n)))
    return out[0].unionByName(out[1])


@query
def q_reidentify_ids(spark, sf_dir):
    """Every pseudonym of the corpus named again through the index of a registry in buckets."""
    registry = _bucket_registry(spark, sf_dir)
    headers = fx.headers(spark, sf_dir)
    first = deid.plan(headers, None, registry.front, source=registry)
    registry = registry.commit(first.assignments)
    run = deid.plan(headers, None, registry.front, committed=first, source=registry)
    return jobs.reidentify_ids(spark, run.output.select("study_id"), registry.root)


# ---- study ID pool -----------------------------------------------------------

FIXTURE_SECRET = "k:"           # test secret; production draws a random one


def corpus_request(spark, sf_dir) -> idpool.PoolRequest:
    """A pool sized to the corpus: one ID per distinct study among ok files."""
    ok = _classified(spark, sf_dir).where(F.col("outcome") == screen.OK)
    n = ok.agg(F.countDistinct("study_uid")).first()[0]
    return idpool.PoolRequest(n=int(n), mask=fx.pool_mask(int(n)), secret=FIXTURE_SECRET)


@query
def q_id_pool(spark, sf_dir):
    return idpool.generate(spark, corpus_request(spark, sf_dir)).select("row_no", "study_id")


@query
def q_id_pool_stats(spark, sf_dir):
    req = corpus_request(spark, sf_dir)
    return idpool.pool_stats(idpool.generate(spark, req), req)


@query
def q_id_pool_full(spark, sf_dir):
    """Three quarters of all IDs that as many digits as the corpus has studies can give."""
    digits = len(str(corpus_request(spark, sf_dir).n))
    req = idpool.PoolRequest(n=10 ** digits * 3 // 4, mask="d" * digits, secret=FIXTURE_SECRET)
    return idpool.generate(spark, req).select("row_no", "study_id")


WIDE_MASK = "uuuuudddddddd"


@query
def q_id_pool_wide(spark, sf_dir):
    """One ID per study from a mask of more than 2^50 IDs."""
    req = idpool.PoolRequest(n=corpus_request(spark, sf_dir).n, mask=WIDE_MASK, secret=FIXTURE_SECRET)
    return idpool.generate(spark, req).select("row_no", "study_id")


@query
def q_id_pool_permuted(spark, sf_dir):
    """One ID per study of the corpus and as many again, as two ranges of one keyed permutation."""
    req = replace(corpus_request(spark, sf_dir), method="permuted").checked()
    pool = idpool.generate(spark, req)
    return pool.unionByName(idpool.permuted(spark, req, req.n, req.n + 2)).select("row_no", "study_id")


def _extension(spark, sf_dir) -> DataFrame:
    """One more ID per new study of the corpus, none of them in the registry's pool."""
    pool = fx.pool(spark, sf_dir)
    k = _new_studies(spark, sf_dir).count()
    n, _ = fx.pool_sizes(spark, sf_dir)
    stats = reg.registry_stats(pool, n)
    req = idpool.PoolRequest(n=max(int(k), 1), mask=fx.pool_mask(n), secret=FIXTURE_SECRET)
    return idpool.extend(spark, pool, req, stats.max_row + 1)


@query
def q_id_pool_extend(spark, sf_dir):
    return _extension(spark, sf_dir).select("row_no", "study_id")


@query
def q_study_assign_over_pool(spark, sf_dir):
    """New studies against a registry with used and free slots past its nominal size."""
    slots, n = fx.over_pool(spark, sf_dir)
    run = deid.plan(fx.headers(spark, sf_dir), slots, {**_front(spark, sf_dir), "n_study_ids": n})
    return run.assignments.select("study_uid", "k", "row_no", "study_id", "over_pool")


@query
def q_reidentify_after_extend(spark, sf_dir):
    """Extend that registry, assign, commit, and name the patient of every file from the committed slots."""
    slots, n = fx.over_pool(spark, sf_dir)
    slots = slots.unionByName(idpool.empty_slots(_extension(spark, sf_dir)))
    headers, front = fx.derived_headers(spark, sf_dir), {**_front(spark, sf_dir), "n_study_ids": n}
    run = deid.plan(headers, slots, front)
    committed = reg.commit(slots, run.assignments, bound=run.n_studies).checkpoint()
    after = deid.plan(headers, committed, front, committed=run)
    return reg.reidentify(after.output.select("path", "study_id"), committed, after.stats.bound).select(
        "path", "study_id", "original_patient_id", "original_study_uid")


# Per-root pool requests: the mask, prefix and suffix are job parameters; n is
# the number of studies found under the root.
ROOT_REQUESTS = {"root0": ("uudddd", "", ""), "root1": ("ldd", "TEST-", "END"), "root2": ("d", "", "")}


@query
def q_mask_capacity(spark, sf_dir):
    ok = _classified(spark, sf_dir).where(F.col("outcome") == screen.OK)
    per_root = ok.groupBy("root").agg(F.countDistinct("study_uid").cast("bigint").alias("n"))
    params = spark.createDataFrame([(r, m, p, s) for r, (m, p, s) in ROOT_REQUESTS.items()],
                                   "root string, mask string, prefix string, suffix string")
    j = per_root.join(F.broadcast(params), "root", "left")  # one parameter row per root
    m = F.col("mask")
    cap = masks.capacity_col(m)
    valid = masks.valid_col(m)
    length = masks.id_length_col(m, F.col("prefix"), F.col("suffix"))
    stat = (F.when(~valid, F.lit("invalid"))
            .when(F.coalesce(F.col("n") > cap, F.lit(False)), F.lit("impossible"))  # a capacity of 38 digits and more is NULL
            .when(F.coalesce(F.col("n") > cap * F.lit(model.SLOW_POOL_FRACTION), F.lit(False)), F.lit("slow"))
            .otherwise(F.lit("ok")))
    return j.select("root", "mask", "prefix", "suffix", "n", valid.alias("valid"),
                    cap.cast("string").alias("capacity"), length.cast("bigint").alias("id_length"),
                    (length > model.MAX_ID_LENGTH).alias("too_long"), stat.alias("status"))


REGISTRY_FILE_NAME = "test file.v1"


@query
def q_study_create(spark, sf_dir):
    ok = _classified(spark, sf_dir).where(F.col("outcome") == screen.OK)
    front = ok.agg(F.countDistinct("study_uid").cast("bigint").alias("n_study_ids"))
    name = F.regexp_replace(F.regexp_replace(F.lit(REGISTRY_FILE_NAME), " ", "_"), r"\.", "")
    return front.select(F.lit("Fixture study").alias("study_title"), F.lit("Fixture PI").alias("pi"),
                        F.lit(model.DEFAULT_IRB_CODE).alias("irb_code"), "n_study_ids",
                        name.alias("registry_name"))


@query
def q_text_valid(spark, sf_dir):
    def valid(c):
        return F.regexp_replace(c, " ", "").rlike(r"^\p{L}+$")
    part = read_table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_name").alias("text"))
    both = part.unionByName(cust)
    return both.select("source", "key", "text", valid(F.col("text")).alias("is_valid"))


# ---- pixels ------------------------------------------------------------------

@query
def q_pixel_diff(spark, sf_dir):
    return pixels.pixel_diff(fx.pixel_pairs(spark, sf_dir))


@query
def q_pixel_stats(spark, sf_dir):
    return pixels.pixel_stats(fx.pixel_pairs(spark, sf_dir))


@query
def q_pixel_equal(spark, sf_dir):
    return pixels.pixel_equal(fx.pixel_pairs(spark, sf_dir))


#: Uneven in the fixture's widths of 8 and 12, so that tiles at the edges are cut short.
QUERY_EDGE = 5


def _tiles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pairs = fx.pixel_pairs(spark, sf_dir)
    return tuple(tiles.cut(pairs.select("pair_id", F.col(s).alias("pixels"), F.col(s + "_rows").alias("n_rows"), F.col(s + "_cols").alias("n_cols")), QUERY_EDGE)
                 for s in ("a", "b"))


@query
def q_pixel_stats_tiled(spark, sf_dir):
    return tiles.tile_stats(*_tiles(spark, sf_dir))


@query
def q_pixel_diff_tiled(spark, sf_dir):
    return tiles.tile_diff(*_tiles(spark, sf_dir)).drop("frame")


# ---- tag edits, header dump, audit log, report -------------------------------

@query
def q_tag_patch(spark, sf_dir):
    h = fx.headers(spark, sf_dir)
    p = patch.apply_patches(h, fx.patches(spark, sf_dir).select("patient_id", "new_accession")).where("has_patch")
    return p.select("path", "patient_id",
                    top_value("elements", model.ACCESSION_NUMBER).alias("accession_before"),
                    top_value("patched", model.ACCESSION_NUMBER).alias("accession_after"))


@query
def q_tag_edit_all(spark, sf_dir):
    """All three fields over all files, those without a patch too."""
    p = patch.apply_patches(fx.headers(spark, sf_dir), fx.patches(spark, sf_dir))
    return p.select("path", "patient_id", "has_patch",
                    top_value("patched", model.PATIENT_ID).alias("patient_id_after"),
                    top_value("patched", model.ACCESSION_NUMBER).alias("accession_after"),
                    top_value("patched", model.STUDY_DATE).alias("study_date_after"))


@query
def q_tag_set(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_custkey")).alias("patient_id"),
        F.concat(F.lit("SET"), F.col("c_custkey")).alias("new_value"),
        (F.col("c_custkey") % 2 == 0).alias("active"))
    return patch.set_report(fx.headers(spark, sf_dir), cust, model.ACCESSION_NUMBER, active="active")


@query
def q_header_dump(spark, sf_dir):
    return dump.header_dump(fx.headers(spark, sf_dir))


@query
def q_header_dump_failures(spark, sf_dir):
    return dump.failures(fx.headers(spark, sf_dir))


AUDIT_LEVEL = model.LOG_HIGH
AUDIT_USER, AUDIT_COMPUTER = "fixture-user", "fixture-host"


@query
def q_audit_log(spark, sf_dir):
    outcomes = _classified(spark, sf_dir).withColumnRenamed("mtime", "ts")
    events = report.file_events(outcomes)
    return report.audit_log(events, AUDIT_LEVEL, 1, AUDIT_USER, AUDIT_COMPUTER)


@query
def q_run_report(spark, sf_dir):
    return deid.run_report(fixture_run(spark, sf_dir).outcomes)


@query
def q_outcome_summary(spark, sf_dir):
    return deid.outcome_summary(fixture_run(spark, sf_dir).outcomes)


@query
def q_header_table(spark, sf_dir):
    """The canonical header table, one row per element (the analyst's long form)."""
    return explode_elements(fx.headers(spark, sf_dir), "path")


VOLUME_IRB = "IRB-V"


@query
def q_deidentify_volume(spark, sf_dir):
    """Lineitem rows as files (a third in one study) through a fresh registry sized to the corpus.

    One row per assigned study ID: files, elements and value characters after the scrub.
    """
    vh = fx.volume_headers(spark, sf_dir)
    n = vh.where(F.col("study_uid").isNotNull()).agg(F.countDistinct("study_uid")).first()[0]
    req = idpool.PoolRequest(n=int(n), mask=fx.pool_mask(int(n)), secret=FIXTURE_SECRET)
    slots = idpool.empty_slots(idpool.generate(spark, req))
    run = deid.plan(vh, slots, {"n_study_ids": int(n), "irb_code": VOLUME_IRB})
    chars = F.aggregate("elements", F.lit(0).cast("bigint"),
                        lambda acc, e: acc + F.coalesce(F.length(e["value"]), F.lit(0)).cast("bigint"))
    return run.output.groupBy("study_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.size("elements")).cast("bigint").alias("n_elements"),
        F.sum(chars).cast("bigint").alias("value_chars"))


def literal_rule_table(spark: SparkSession) -> DataFrame:
    """The reference's hard-coded rules as a rule table, request-sequence removal left out
    (its guard never fires there). Configuration: a few dozen rows."""
    rows = [("drop_private", None, None, None, None, None)]
    rows += [("set_vr", vr, value, None, None, None) for vr, value in model.VR_REPLACEMENTS.items()]
    rows += [("drop_group", None, None, model.CURVE_GROUP_VALUE, model.CURVE_GROUP_MASK, None)]
    rows += [("upsert", f.vr, f.value, f.tag, None, f.keyword) for f in model.FIXED_ASSIGNMENTS]
    return spark.createDataFrame(rows, "action string, vr string, value string, tag bigint, mask bigint, "
                                       "keyword string")


@query
def q_deidentify_rules(spark, sf_dir):
    """Full de-identification driven by a rule table (R1)."""
    rules = scrub_ops.Rules.from_rows(literal_rule_table(spark).collect())  # config rows
    headers = fx.headers(spark, sf_dir)
    run = deid.plan(headers, fx.pool(spark, sf_dir), _front(spark, sf_dir), rules=rules)
    return explode_elements(run.output, "path", "out_path", "study_id")


def path_rule_table(spark: SparkSession) -> DataFrame:
    """The default rules and rules for nested elements. Configuration."""
    rows = [(*r, None) for r in literal_rule_table(spark).collect()]  # config rows
    rows += [("drop_tag", None, None, model.REQUEST_ATTRIBUTES_SEQUENCE, None, None, None),
             ("set_path", None, "19000101", None, None, None, "528656/524320"), ("drop_path", None, None, None, None, None, "528656/2097165"),
             ("set_path", None, "gone", None, None, None, "1358954512"), ("drop_path", None, None, None, None, None, "528656/2097165/1")]
    return spark.createDataFrame(rows, "action string, vr string, value string, tag bigint, mask bigint, keyword string, path string")


@query
def q_deidentify_paths(spark, sf_dir):
    """Full de-identification by the default rules and rules for elements inside sequences."""
    rules = scrub_ops.Rules.from_rows(path_rule_table(spark).collect())  # config rows
    run = deid.plan(fx.headers(spark, sf_dir), fx.pool(spark, sf_dir), _front(spark, sf_dir), rules=rules)
    return explode_elements(run.output, "path", "out_path", "study_id")
