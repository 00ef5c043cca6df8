"""Study registry storage: Parquet tables under one folder, slots versioned.

    <registry>/study/            one-row front table (title, PI, IRB code, n)
    <registry>/slots/<folder>/   full slot tables and tables of changed slots
    <registry>/commits/v<N>      one small JSON file per version
    <registry>/audit_log/        append-only log
    <registry>/sequence/s<n>     claimed ranges of audit-log numbers

A version is its commit file: it names a full slot table, the tables of changed
slots since, and the pool size n. A writer writes its slots to a folder of its
own, checks the slots that result, and then claims version N+1 by creating that
commit file, which fails if it is there. Readers follow commit files only, so
folders of writers that died or lost the claim are never seen; a commit file
without its content (a writer that died in the claim) is no version either. A
run commits before any de-identified file is written, so a crash never leaves
files whose pseudonyms are not recorded. Runs write only the slots they fill;
every ``SNAPSHOT_EVERY`` versions the full table is written again.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import model
from incognita.operators import idpool
from incognita.operators import registry_ops as reg

#: Tables of changed slots that a version may stack before the full table is written again.
SNAPSHOT_EVERY = 20


class RegistryError(RuntimeError):
    pass


@dataclass
class Registry:
    root: str
    front: dict
    slots: DataFrame
    version: int
    base: str = ""
    changes: list[str] = field(default_factory=list)


def _path(root: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}"


# ---- files of any Spark file system ------------------------------------------

def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that must not exist; False if it does."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # the local file system has no exclusive create; a hard link is one
        local = fs.makeQualified(p).toUri().getPath()
        temp = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(temp, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(temp, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
        return True
    try:
        out = fs.create(p, False)
    except Exception as exc:  # the claim failed because the file is there, or for another reason
        if fs.exists(p):
            return False
        raise RegistryError(f"cannot write {path}") from exc
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def _listed(spark: SparkSession, root: str) -> dict[int, object]:
    """Version -> path of its commit file, by name; no file is opened."""
    folder = _path(root, "commits")
    if not exists(spark, folder):
        return {}
    fs, p = _fs(spark, folder)
    names = {s.getPath().getName(): s.getPath() for s in fs.listStatus(p)}
    return {int(m.group(1)): path for name, path in names.items() if (m := re.fullmatch(r"v(\d+)", name))}


def _read_text(spark: SparkSession, jpath) -> str:
    stream = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(jpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _content(spark: SparkSession, jpath) -> dict | None:
    """Content of a commit file; None if it has none (a writer that died in the claim)."""
    try:
        return json.loads(_read_text(spark, jpath))
    except ValueError:
        return None


def newest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """The latest version and its content: the newest commit file that has one is opened, older ones are not."""
    listed = _listed(spark, root)
    for v in sorted(listed, reverse=True):
        content = _content(spark, listed[v])
        if content:
            return v, content
    return None


def versions(spark: SparkSession, root: str) -> list[int]:
    return [v for v, path in sorted(_listed(spark, root).items()) if _content(spark, path)]


# ---- slots -------------------------------------------------------------------

def _conform(slots: DataFrame) -> DataFrame:
    cols = []
    for f in model.SLOTS.fields:
        c = F.col(f.name) if f.name in slots.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return slots.select(*cols)


def _write_slots(root: str, slots: DataFrame) -> str:
    """Write to a folder that nobody else knows; returns its name."""
    name = uuid.uuid4().hex
    _conform(slots).write.mode("errorifexists").parquet(_path(root, f"slots/{name}"))
    return name


def _read_slots(spark: SparkSession, root: str, base: str, changes: list[str]) -> DataFrame:
    read = spark.read.schema(model.SLOTS)
    slots = read.parquet(_path(root, f"slots/{base}"))
    if not changes:
        return slots
    # A slot is filled once and never changes again, so changed rows are disjoint.
    new = read.parquet(*[_path(root, f"slots/{c}") for c in changes])
    return slots.join(new.select("row_no"), "row_no", "left_anti").unionByName(new)


def study_folder(parent: str, name: str) -> str:
    """Folder of a registry with a cleaned name: no spaces, no dots."""
    return f"{parent.rstrip('/')}/{idpool.clean_registry_name(name)}"


def write_front(spark: SparkSession, root: str, title: str, pi: str, irb_code: str, n_study_ids: int) -> None:
    front = spark.createDataFrame([(title, pi, irb_code, int(n_study_ids))], model.STUDY)
    front.coalesce(1).write.mode("errorifexists").parquet(_path(root, "study"))


def create(spark: SparkSession, root: str, title: str, pi: str, pool: DataFrame, n_study_ids: int,
           irb_code: str = model.DEFAULT_IRB_CODE, user: str = "", computer: str = "",
           creation_messages: list[str] | None = None) -> Registry:
    """Write a new registry: front table, slot version 1 and the creation log lines."""
    if _listed(spark, root):
        raise RegistryError(f"registry {root} already exists")
    write_front(spark, root, title, pi, irb_code, n_study_ids)
    base = _write_slots(root, pool)
    _claim(spark, root, 1, {"base": base, "changes": [], "n_study_ids": int(n_study_ids), "parent": 0})
    msgs = creation_messages or [model.MSG_STUDY_CREATED.format(title=title, pi=pi)]
    append_log(spark, root, [(model.LOG_NORMAL, m) for m in msgs], user, computer)
    return load(spark, root, check=False)


def load(spark: SparkSession, root: str, check: bool = True) -> Registry:
    """Read the latest version; raise listing every missing part or failed check."""
    missing = [f"no '{part}' table" for part in ("study", "slots", "audit_log") if not exists(spark, _path(root, part))]
    last = newest(spark, root)
    if not last and "no 'slots' table" not in missing:
        missing.append("no committed slot version")
    if missing:
        raise RegistryError(f"registry {root} is not valid: " + "; ".join(missing))
    v, commit = last
    lost = [x for x, path in _listed(spark, root).items() if commit["parent"] < x < v and _content(spark, path)]
    if lost:
        raise RegistryError(f"registry {root}: version {v} does not follow version {max(lost)}")
    front = spark.read.parquet(_path(root, "study")).first().asDict()  # one row
    front["n_study_ids"] = commit["n_study_ids"]
    slots = _read_slots(spark, root, commit["base"], commit["changes"])
    r = Registry(root, front, slots, v, commit["base"], commit["changes"])
    if check:
        _refuse(slots, front["n_study_ids"], f"registry {root} v={v}")
    return r


def _refuse(slots: DataFrame, n_study_ids: int, what: str) -> None:
    problems = problems_of(check_slots(slots, int(n_study_ids)))
    if problems:
        raise RegistryError(f"{what} failed checks: " + "; ".join(problems))


def _claim(spark: SparkSession, root: str, version: int, content: dict) -> None:
    if not _create_new(spark, _path(root, f"commits/v{version:010d}"), json.dumps(content)):
        raise RegistryError(f"registry {root} already has version {version}: concurrent writer")


def _next(spark: SparkSession, root: str, version: int) -> int:
    """The number after a version's; commit files that died in the claim are passed over."""
    listed = _listed(spark, root)
    v = version + 1
    while v in listed and _content(spark, listed[v]) is None:
        v += 1
    return v


def commit(spark: SparkSession, registry: Registry, new_slots: DataFrame, n_study_ids: int | None = None) -> Registry:
    """Write a full slot table as the next version and return it re-read."""
    return _commit(spark, registry, _write_slots(registry.root, new_slots), None, n_study_ids)


def commit_changes(spark: SparkSession, registry: Registry, changed: DataFrame, n_study_ids: int | None = None) -> Registry:
    """Write only the slots that a run filled as the next version and return it re-read.

    Anything else (added slots, say) is a new full table: see ``commit``.
    """
    return _commit(spark, registry, None, _write_slots(registry.root, changed), n_study_ids)


def _commit(spark: SparkSession, registry: Registry, base: str | None, change: str | None, n_study_ids: int | None) -> Registry:
    root, n = registry.root, int(n_study_ids or registry.front["n_study_ids"])
    changes = [] if base else [*registry.changes, change]
    mine = [base or change]
    try:
        slots = _read_slots(spark, root, base or registry.base, changes)
        _refuse(slots, n, f"registry {root}: the new slots")
        if len(changes) > SNAPSHOT_EVERY:
            base, changes = _write_slots(root, slots), []
            mine.append(base)
        _claim(spark, root, _next(spark, root, registry.version),
               {"base": base or registry.base, "changes": changes, "n_study_ids": n, "parent": registry.version})
    except RegistryError:
        for folder in mine:
            _delete(spark, _path(root, f"slots/{folder}"))
        raise
    for folder in mine[:-1]:  # its slots are in the full table
        _delete(spark, _path(root, f"slots/{folder}"))
    return load(spark, root, check=False)  # what was checked above


# ---- audit log ---------------------------------------------------------------

#: Numbers passed over for a claim whose writer died before it wrote how many it took.
LOST_CLAIM = 1 << 32


def reserve(spark: SparkSession, root: str, n: int) -> int:
    """Take ``n`` audit-log numbers that nobody else gets; returns the first.

    A range is claimed by creating ``sequence/s<first>`` with its length, which
    fails if another writer was first; the next range begins behind the last one.
    Only the newest claim is opened, the log itself is not read.
    """
    folder = _path(root, "sequence")
    while True:
        first = _next_number(spark, root, folder)
        if _create_new(spark, f"{folder}/s{first:020d}", json.dumps({"n": int(n)})):
            return first


def _next_number(spark: SparkSession, root: str, folder: str) -> int:
    claims = {}
    if exists(spark, folder):
        fs, p = _fs(spark, folder)
        names = {s.getPath().getName(): s.getPath() for s in fs.listStatus(p)}
        claims = {int(m.group(1)): path for name, path in names.items() if (m := re.fullmatch(r"s(\d+)", name))}
    if not claims:  # a new log, or one from before numbers were claimed
        return last_seq(spark, root) + 1
    last = max(claims)
    content = _content(spark, claims[last])
    return last + (content["n"] if content else LOST_CLAIM)


def last_seq(spark: SparkSession, root: str) -> int:
    """Last number in the log, by a scan of it."""
    path = _path(root, "audit_log")
    if not exists(spark, path):
        return 0
    return int(spark.read.schema(model.AUDIT_LOG).parquet(path).agg(F.max("seq")).first()[0] or 0)


def append_log(spark: SparkSession, root: str, entries: list[tuple[int, str]], user: str = "",
               computer: str = "") -> None:
    """Append run-level log lines (level, message) with numbers of their own."""
    first = reserve(spark, root, len(entries))
    rows = [(first + i, lvl, msg, user, computer) for i, (lvl, msg) in enumerate(entries)]
    df = spark.createDataFrame(rows, "seq bigint, level int, activity string, user string, computer string")
    df = df.select("seq", F.current_timestamp().alias("ts"), "level", "activity", "user", "computer")
    df.coalesce(1).write.mode("append").parquet(_path(root, "audit_log"))


def append_log_frame(root: str, log: DataFrame) -> None:
    """Append an already numbered log frame (see operators.report.audit_log)."""
    log.select(*[F.col(f.name).cast(f.dataType) for f in model.AUDIT_LOG.fields]) \
       .write.mode("append").parquet(_path(root, "audit_log"))


def check_slots(slots: DataFrame, n_study_ids: int) -> DataFrame:
    """Registry checks as rows (check, value); NULL value means "none"."""
    last = n_study_ids + 1
    in_range = (F.col("row_no") >= 2) & (F.col("row_no") <= last)
    a = slots.agg(
        F.lit(n_study_ids).cast("bigint").alias("n_study_ids"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count(F.when(reg.assigned(), 1)).cast("bigint").alias("n_assigned"),
        F.countDistinct(F.when(reg.assigned(), F.col("study_uid"))).cast("bigint").alias("n_known_studies"),
        F.min(F.when(~reg.assigned() & in_range, F.col("row_no"))).alias("_ff"),
        F.max(F.when(reg.assigned(), F.col("row_no"))).alias("_max_assigned"),
        F.count(F.when(in_range & (F.coalesce(F.col("study_id"), F.lit("")) == ""), 1)).cast("bigint")
        .alias("n_missing_ids"),
        (F.lit(n_study_ids) - F.count(F.when(in_range, 1))).cast("bigint").alias("n_missing_rows"),
    )
    a = a.select("*", F.coalesce("_ff", F.lit(last + 1)).cast("bigint").alias("first_free_row"),
                 F.when(F.col("_ff") < F.col("_max_assigned"), F.col("_ff")).cast("bigint").alias("first_gap_row"))
    names = ["n_study_ids", "n_rows", "n_assigned", "n_known_studies", "first_free_row", "first_gap_row",
             "n_missing_ids", "n_missing_rows"]
    stacked = a.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in names])).alias("s")).select("s.*")
    used = slots.where(reg.assigned())
    dup_uids = (used.where(F.col("study_uid").isNotNull()).groupBy("study_uid").count()
                .where(F.col("count") > 1).agg(F.count(F.lit(1)).cast("bigint").alias("value"))
                .select(F.lit("n_dup_uids").alias("check"), "value"))
    dup_ids = (slots.where(F.col("study_id").isNotNull()).groupBy("study_id").count()
               .where(F.col("count") > 1).agg(F.count(F.lit(1)).cast("bigint").alias("value"))
               .select(F.lit("n_dup_ids").alias("check"), "value"))
    return stacked.unionByName(dup_uids).unionByName(dup_ids)


def problems_of(checks: DataFrame) -> list[str]:
    """Problems found by ``check_slots`` (a handful of rows, collected)."""
    vals = {r["check"]: r["value"] for r in checks.collect()}
    out = []
    if vals.get("first_gap_row") is not None:
        out.append(f"gap at row {vals['first_gap_row']}: later rows are assigned")
    for k, label in (("n_missing_ids", "slots without a study ID"), ("n_dup_uids", "study UIDs assigned twice"), ("n_dup_ids", "study IDs repeated"),
                     ("n_missing_rows", "slot rows missing")):
        if vals.get(k):
            out.append(f"{vals[k]} {label}")
    return out


def prune_versions(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Delete all but the newest ``keep`` versions (keep >= 1) and the slot folders that only they use.

    Explicit and opt-in: old versions are the registry's history. Folders that no
    commit file names stay, as a writer may be at work on one.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1: the latest version is never deleted")
    commits = {v: c for v, path in _listed(spark, root).items() if (c := _content(spark, path))}
    doomed = sorted(commits)[:-keep]
    kept = {f for v, c in commits.items() if v not in doomed for f in [c["base"], *c["changes"]]}
    for v in doomed:
        _delete(spark, _path(root, f"commits/v{v:010d}"))
    for f in {f for v in doomed for f in [commits[v]["base"], *commits[v]["changes"]]} - kept:
        _delete(spark, _path(root, f"slots/{f}"))
    return doomed
