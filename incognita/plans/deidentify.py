"""Batch de-identification as one Spark plan.

    headers --classify (narrow; key columns only)--> files with study_uid and outcome
      ok files --groupBy study_uid (partial agg)--> first file per study (materialised, counted)
        --left_anti registry index--> new studies
        --consecutive numbering--> k --equi-join the k-th free slot--> assignments
      all files --join study map (<= counted batch studies; broadcast within budget)--> study_id
        --scrub (narrow, array functions)--> de-identified headers; exhausted -> outcome

Only study-level data shuffles; the per-file work is narrow, and the study
pass reads only the key columns of a stored header table. ``plans.jobs``
commits the registry before any output is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.operators import registry_ops as reg
from incognita.operators import screen
from incognita.operators.scrub import DEFAULT_RULES, Rules, anon_name, output_path, scrub
from incognita.sources.buckets import BucketRegistry


@dataclass
class Run:
    classified: DataFrame      # every file: path, root, root_ord, study_uid, outcome, message, elements
    stats: reg.RegistryStats
    index: DataFrame           # known studies before the run
    firsts: DataFrame          # first file per study among ok files
    new: DataFrame             # studies not in the registry
    assigned: DataFrame        # new studies with their slot (study_id NULL = exhausted)
    assignments: DataFrame     # the same with the registry values of the first file
    files: DataFrame           # ok files with study_id (NULL = exhausted)
    outcomes: DataFrame        # every file with its final outcome
    n_studies: int             # distinct studies among ok files (bounds the study map)
    map_row_bytes: int         # bytes of a row of the study map at most
    hot: list[str]             # studies that hold a large share of the files
    irb_code: str = ""
    rules: Rules = field(default=DEFAULT_RULES)

    @property
    def output(self) -> DataFrame:
        """De-identified files: path, root, out_path, study_id, elements (built on use)."""
        name = anon_name(F.lit(self.irb_code), F.col("root"))
        return (self.files.where(F.col("study_id").isNotNull())
                .select("path", "root", output_path().alias("out_path"), "study_id",
                        scrub("elements", F.col("study_id"), name, self.rules).alias("elements")))


def plan(headers: DataFrame, slots: DataFrame | None, front: dict, rules: Rules = DEFAULT_RULES,
         committed: Run | None = None, source: BucketRegistry | None = None) -> Run:
    """Build the run's DataFrames. ``front`` holds irb_code and n_study_ids.

    Known studies and free slots come from a slot table, or from ``source``, a
    registry in buckets that reads only what the batch's studies touch.

    ``committed`` is the first pass over the same files, whose assignments
    ``slots`` now holds: studies then get their IDs by lookup alone, none are
    assigned (a study without one is exhausted), and its study pass is not run again.
    """
    classified = screen.classify(headers)
    ok = classified.where(F.col("outcome") == screen.OK)
    stats = reg.registry_stats(slots, int(front["n_study_ids"])) if source is None else source.stats()
    # Studies of this batch, materialised and counted: the count bounds every
    # study-keyed table joined back to the files.
    if committed is None:
        firsts = reg.study_firsts(ok).checkpoint(eager=True)
        size = firsts.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("study_uid")).alias("w"),
                          F.max(F.octet_length("path")).alias("p"), F.sum("n_files").alias("files")).first()
        hot = reg.hot_studies(firsts, int(size["files"] or 0))
        n_studies = max(int(size["n"]), 1)
        # Row-size bound of the study map: the longest UID of the batch plus an ID
        # of at most MAX_ID_BYTES and per-row overhead.
        map_row_bytes = int(size["w"] or 0) + reg.MAX_ID_BYTES + reg.ROW_OVERHEAD_BYTES
        index = reg.registry_index(slots) if source is None else source.known(firsts.select("study_uid"))
        new = reg.new_studies(firsts, index)
        if source is None:
            assigned = reg.assign_slots(new, slots, stats)
        else:
            ranked = reg.ranked_studies(new)
            wanted = ranked.count()
            assigned = reg.give_slots(ranked, source.free(wanted), wanted, stats)
        assignments = reg.with_values(assigned, ok, n_studies, map_row_bytes + int(size["p"] or 0) + 32)
    else:
        firsts, n_studies, map_row_bytes, hot = committed.firsts, committed.n_studies, committed.map_row_bytes, committed.hot
        index = reg.registry_index(slots) if source is None else source.known(firsts.select("study_uid"))
        new, assignments = committed.new, committed.assignments.limit(0)
        assigned = committed.assigned.limit(0)
    batch_ids = firsts.select("study_uid")
    known = index.join(reg.bounded_broadcast(batch_ids, n_studies, map_row_bytes), "study_uid", "left_semi")
    mapping = reg.study_map(known, assigned)
    # Every file gets its study's ID through one join keyed by study (broadcast
    # while the counted batch studies fit the budget); no path-keyed shuffle.
    # Past the budget hot studies keep a broadcast and a bucketed header table
    # joins in place (see ``reg.lookup``).
    labelled = reg.lookup(classified, mapping.select("study_uid", "study_id"), n_studies, map_row_bytes, hot)
    files = labelled.where(F.col("outcome") == screen.OK)
    irb = front.get("irb_code") or ""
    exhausted = (F.col("outcome") == screen.OK) & F.col("study_id").isNull()
    outcomes = (labelled
                .withColumn("message", F.when(exhausted, F.concat(screen.file_name("path"),
                                                                  F.lit(" -no study ID left")))
                            .otherwise(F.col("message")))
                .withColumn("outcome", F.when(exhausted, F.lit(screen.EXHAUSTED)).otherwise(F.col("outcome")))
                .drop("study_id"))
    return Run(classified, stats, index, firsts, new, assigned, assignments, files, outcomes, n_studies, map_row_bytes, hot, irb, rules)


def run_report(outcomes: DataFrame) -> DataFrame:
    """Counters per root and in total, as the reference prints them (``is_total`` tells a NULL root from the total)."""
    o = F.col("outcome")
    return outcomes.withColumn("_dir", screen.parent_dir("path")).rollup("root").agg(
        (F.grouping_id() == 1).alias("is_total"),
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct("_dir").alias("n_dirs"),
        F.count(F.when(o.isin(screen.NO_UID, screen.OK, screen.EXHAUSTED), 1)).alias("n_valid"),
        F.count(F.when(o.isin(screen.SKIPLIST, screen.NO_UID), 1)).alias("n_skipped"),
        F.count(F.when(o.isin(screen.NOT_DICOM, screen.UNREADABLE), 1)).alias("n_non_dicom"),
        F.count(F.when(o == screen.OK, 1)).alias("n_anonymised"),
        F.count(F.when(o == screen.EXHAUSTED, 1)).alias("n_exhausted"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Per outcome: file count, roots touched and the first/last message (bounded per group)."""
    return outcomes.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.countDistinct("root").alias("n_roots"),
        F.min("message").alias("first_message"),
        F.max("message").alias("last_message"),
    )
