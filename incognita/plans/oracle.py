"""DuckDB SQL for every registered query (the correctness oracle).

The fixture relations of FIXTURES.md are shared CTEs; ``sql(final, *needs)``
prepends the CTEs a query needs (with their dependencies) in order.
"""

from __future__ import annotations

from incognita import model

# 24 fixed assignments as VALUES rows: (tag, keyword, vr, value, ord)
_FIXED_VALUES = ",\n    ".join(
    f"({f.tag}, '{f.keyword}', '{f.vr}', '{f.value}', {i})" for i, f in enumerate(model.FIXED_ASSIGNMENTS))
FIXED_TAGS = ", ".join(str(f.tag) for f in model.FIXED_ASSIGNMENTS)

CTES: dict[str, tuple[list[str], str]] = {}


def digits(n: str) -> str:
    """Digits of the corpus mask for n IDs: two letters and at least four digits, as many as n has."""
    return f"CAST(greatest(4, length(CAST({n} AS VARCHAR))) AS INTEGER)"


def power(k: str) -> str:
    return f"CAST(pow(10, {k}) AS BIGINT)"


def decoded(code: str, k: str) -> str:
    """The ID of a code under the mask of two upper-case letters and k digits."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    return (f"concat(substr({letters}, CAST({code} // (26 * {power(k)}) AS INT) + 1, 1), "
            f"substr({letters}, CAST(({code} % (26 * {power(k)})) // {power(k)} AS INT) + 1, 1), "
            f"lpad(CAST({code} % {power(k)} AS VARCHAR), {k}, '0'))")


def drawn(cap: str, draw: str = "draw", group: str = "") -> str:
    """Code of a draw: 60 bits of the keyed hash modulo the capacity."""
    return f"CAST('0x' || substr(sha256(concat('k:', CAST({draw} AS VARCHAR), '{group}')), 1, 15) AS BIGINT) % ({cap})"


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = (deps or [], body)


cte("inst", """
  SELECT event_id, user_id, event_type, props, ts,
    concat('root', user_id % 3) AS root,
    CAST(user_id % 3 AS INTEGER) AS root_ord,
    concat('root', user_id % 3, '/p', user_id, '/e', event_id, '/',
      CASE WHEN event_id % 97 = 0 THEN 'DICOMDIR' ELSE concat('i', event_id, '.dcm') END) AS path,
    CASE WHEN event_id % 31 = 0 THEN 'JUNK' ELSE 'DICM' END AS magic,
    CASE WHEN event_id % 53 = 0 THEN 'bad header' END AS parse_error,
    CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS VARCHAR) AS ymd,
    lpad(CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS VARCHAR), 6, '0') AS hms
  FROM events""")

cte("elements", """
  SELECT path, event_id, 524320 AS top_tag, -1 AS item, 524320 AS tag, 'StudyDate' AS keyword, 'DA' AS vr, ymd AS value FROM inst
  UNION ALL SELECT path, event_id, 524336, -1, 524336, 'StudyTime', 'TM', hms FROM inst
  UNION ALL SELECT path, event_id, 524368, -1, 524368, 'AccessionNumber', 'SH', concat('ACC', event_id) FROM inst WHERE event_id % 7 <> 0
  UNION ALL SELECT path, event_id, 524384, -1, 524384, 'Modality', 'CS', upper(event_type) FROM inst
  UNION ALL SELECT path, event_id, 528432, -1, 528432, 'StudyDescription', 'LO', '' FROM inst
  UNION ALL SELECT path, event_id, 528656, -1, 528656, 'ReferencedStudySequence', 'SQ', '' FROM inst WHERE event_id % 200 = 3
  UNION ALL SELECT path, event_id, 528656, 0, 524320, 'StudyDate', 'DA', ymd FROM inst WHERE event_id % 200 = 3
  UNION ALL SELECT path, event_id, 528656, 0, 2097165, 'StudyInstanceUID', 'UI', concat('9.9.', user_id) FROM inst WHERE event_id % 200 = 3
  UNION ALL SELECT path, event_id, 1048592, -1, 1048592, 'PatientName', 'PN', concat('USER^', user_id) FROM inst WHERE event_id % 11 <> 0
  UNION ALL SELECT path, event_id, 1048608, -1, 1048608, 'PatientID', 'LO', concat('P', user_id) FROM inst
  UNION ALL SELECT path, event_id, 1118209, -1, 1118209, '', 'LO', props FROM inst
  UNION ALL SELECT path, event_id, 1118210, -1, 1118210, '', 'SQ', '' FROM inst WHERE event_id % 13 = 0
  UNION ALL SELECT path, event_id, 1118210, 0, 1048592, 'PatientName', 'PN', concat('USER^', user_id) FROM inst WHERE event_id % 13 = 0
  UNION ALL SELECT path, event_id, 2097165, -1, 2097165, 'StudyInstanceUID', 'UI',
      CASE WHEN event_id % 250 = 1 THEN '' ELSE concat('1.2.', user_id, '.', ymd) END FROM inst WHERE event_id % 50 <> 0
  UNION ALL SELECT path, event_id, 2097168, -1, 2097168, 'StudyID', 'SH', concat('ACC', event_id) FROM inst
  UNION ALL SELECT path, event_id, 4194933, -1, 4194933, 'RequestAttributesSequence', 'SQ', '' FROM inst WHERE event_id % 5 = 0
  UNION ALL SELECT path, event_id, 4194933, 0, 4198401, 'RequestedProcedureID', 'SH', concat('RP', event_id) FROM inst WHERE event_id % 5 = 0
  UNION ALL SELECT path, event_id, 4235552, -1, 4235552, 'DateTime', 'DT', concat(ymd, hms) FROM inst
  UNION ALL SELECT path, event_id, 1342189568, -1, 1342189568, 'CurveData', 'OW', 'curve' FROM inst WHERE event_id % 4 = 0
  UNION ALL SELECT path, event_id, 1358954512, -1, 1358954512, '', 'LO', 'not a curve' FROM inst WHERE event_id % 4 = 1""",
    ["inst"])

cte("uids", """
  SELECT path, value AS study_uid FROM (
    SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY top_tag, item, tag) AS rn
    FROM elements WHERE tag = 2097165) t WHERE rn = 1""", ["elements"])

cte("old_studies", """
  SELECT study_uid, patient_id, row_number() OVER (ORDER BY study_uid) AS k
  FROM (SELECT DISTINCT concat('1.2.', user_id, '.', ymd) AS study_uid, concat('P', user_id) AS patient_id FROM inst) t""",
    ["inst"])

cte("pool_sizes", """
  SELECT count(*) * 35 // 100 AS slots, greatest(count(*) * 5 // 100, 100) AS assigned FROM events""")

cte("codes", f"""
  SELECT i + 1 AS k, (i * 7919 + 13) % (676 * {power('w')}) AS code, w
  FROM (SELECT unnest(range(slots)) AS i, {digits('slots')} AS w FROM pool_sizes)""", ["pool_sizes"])

cte("pool", f"""
  SELECT CAST(c.k + 1 AS BIGINT) AS row_no, {decoded('code', 'w')} AS study_id,
    o.patient_id, o.study_uid
  FROM codes c LEFT JOIN (SELECT * FROM old_studies WHERE k <= (SELECT assigned FROM pool_sizes)) o ON c.k = o.k""",
    ["codes", "old_studies", "pool_sizes"])

cte("pool_gap", """
  SELECT row_no, study_id, CASE WHEN row_no = 100 THEN NULL ELSE patient_id END AS patient_id, study_uid FROM pool""",
    ["pool"])

cte("pool_dup", """
  SELECT row_no, study_id, patient_id,
    CASE WHEN row_no = 11 THEN (SELECT max(study_uid) FROM pool WHERE row_no = 10) ELSE study_uid END AS study_uid
  FROM pool""", ["pool"])

cte("front", """
  SELECT CAST(count(*) AS BIGINT) AS n_study_ids, 'IRBcode1234' AS irb_code FROM codes""", ["codes"])

cte("fixed", f"""
  SELECT * FROM (VALUES
    {_FIXED_VALUES}) AS t(tag, keyword, vr, value, ord)""")

# ---- screening ---------------------------------------------------------------
cte("outcomes0", """
  SELECT i.path, i.root, i.root_ord, u.study_uid, regexp_extract(i.path, '([^/]*)$', 1) AS fname,
    CASE WHEN regexp_extract(i.path, '([^/]*)$', 1) IN ('DICOMDIR', 'VERSION', 'LOCKFILE') THEN 'skiplist'
         WHEN coalesce(i.magic, '') <> 'DICM' THEN 'not_dicom'
         WHEN i.parse_error IS NOT NULL THEN 'unreadable'
         WHEN coalesce(u.study_uid, '') = '' THEN 'no_uid'
         ELSE 'ok' END AS outcome
  FROM inst i LEFT JOIN uids u ON i.path = u.path""", ["inst", "uids"])

cte("outcomes", """
  SELECT path, root, root_ord, study_uid, fname, outcome,
    CASE outcome WHEN 'skiplist' THEN fname
                 WHEN 'not_dicom' THEN fname || ': fourcc failed- non-dicom'
                 WHEN 'unreadable' THEN fname || ': load failed- non-dicom'
                 WHEN 'no_uid' THEN fname || ' -No studyUID' END AS message
  FROM outcomes0""", ["outcomes0"])

cte("ok_files", "SELECT path, root, root_ord, study_uid FROM outcomes WHERE outcome = 'ok'", ["outcomes"])

# top-level values of the first file of each study (registry row values)
cte("top_vals", """
  SELECT path,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 1048592), 'Nil') AS patient_name,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 1048608), 'Nil') AS patient_id,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 524368), 'Nil') AS accession_number,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 524320), 'Nil') AS study_date,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 524336), 'Nil') AS study_time,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 2097165), 'Nil') AS top_study_uid,
    coalesce(max(value) FILTER (WHERE item = -1 AND tag = 528432), 'Nil') AS study_description
  FROM elements GROUP BY path""", ["elements"])

# ---- registry ---------------------------------------------------------------
cte("reg_index", """
  SELECT study_uid, CAST(max(row_no) AS BIGINT) AS row_no, arg_max(study_id, row_no) AS study_id
  FROM pool WHERE study_id IS NOT NULL AND patient_id IS NOT NULL AND study_uid IS NOT NULL
  GROUP BY study_uid""", ["pool"])

cte("first_free", """
  SELECT CAST(coalesce(min(row_no) FILTER (WHERE NOT (study_id IS NOT NULL AND patient_id IS NOT NULL)
                                          AND row_no >= 2 AND row_no <= (SELECT n_study_ids + 1 FROM front)),
                       (SELECT n_study_ids + 2 FROM front)) AS BIGINT) AS first_free_row
  FROM pool""", ["pool", "front"])

cte("firsts", """
  SELECT study_uid, root_ord, path FROM (
    SELECT study_uid, root_ord, path,
      row_number() OVER (PARTITION BY study_uid ORDER BY root_ord, path) AS rn FROM ok_files) t
  WHERE rn = 1""", ["ok_files"])

cte("new_studies", """
  SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM reg_index r WHERE r.study_uid = f.study_uid)""",
    ["firsts", "reg_index"])

# unassigned slots with an ID, numbered in row order
cte("free", """
  SELECT row_no, study_id, row_number() OVER (ORDER BY row_no) AS k
  FROM pool WHERE NOT (study_id IS NOT NULL AND patient_id IS NOT NULL) AND coalesce(study_id, '') <> '' AND row_no >= 2""",
    ["pool"])

cte("assignments", """
  SELECT n.study_uid, n.k, f.row_no, f.study_id, coalesce(f.row_no > (SELECT n_study_ids + 1 FROM front), false) AS over_pool,
    v.patient_name, v.patient_id, v.accession_number, v.study_date, v.study_time, v.study_description,
    n.path AS first_path
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY root_ord, path, study_uid) AS BIGINT) AS k FROM new_studies) n
  LEFT JOIN free f ON f.k = n.k
  LEFT JOIN top_vals v ON v.path = n.path""", ["new_studies", "free", "front", "top_vals"])

cte("study_map", """
  SELECT study_uid, study_id, row_no FROM reg_index
  UNION ALL SELECT study_uid, study_id, row_no FROM assignments WHERE study_id IS NOT NULL""",
    ["reg_index", "assignments"])

cte("deid_files", """
  SELECT f.path, f.root, f.root || '-anon' || substr(f.path, length(f.root) + 1) AS out_path, m.study_id
  FROM ok_files f JOIN study_map m ON f.study_uid = m.study_uid""", ["ok_files", "study_map"])

cte("final_outcomes", """
  SELECT o.path, o.root, o.study_uid,
    CASE WHEN o.outcome = 'ok' AND m.study_id IS NULL THEN 'exhausted' ELSE o.outcome END AS outcome,
    CASE WHEN o.outcome = 'ok' AND m.study_id IS NULL THEN o.fname || ' -no study ID left' ELSE o.message END AS message
  FROM outcomes o LEFT JOIN study_map m ON o.study_uid = m.study_uid AND o.outcome = 'ok'""",
    ["outcomes", "study_map"])

# scrub of one file's elements in the reference order; depth <= 1 in the fixture
cte("deid_elements", f"""
  SELECT d.path, d.out_path, d.study_id, e.top_tag, e.item, e.tag, e.keyword, e.vr,
    CASE e.vr WHEN 'PN' THEN 'anonymous' WHEN 'DA' THEN '' WHEN 'TM' THEN '' ELSE e.value END AS value
  FROM deid_files d JOIN elements e ON d.path = e.path
  WHERE (e.top_tag // 65536) % 2 = 0 AND (e.tag // 65536) % 2 = 0
    AND ((e.top_tag // 65536) & 65280) <> 20480 AND ((e.tag // 65536) & 65280) <> 20480
    AND e.top_tag NOT IN ({FIXED_TAGS})
    AND e.top_tag <> 4194933 AND e.tag <> 4194933
  UNION ALL
  SELECT d.path, d.out_path, d.study_id, x.tag, -1, x.tag, x.keyword, x.vr,
    CASE x.keyword WHEN 'PatientID' THEN d.study_id WHEN 'PatientName' THEN (SELECT irb_code FROM front)
                   ELSE x.value END
  FROM deid_files d, fixed x""", ["deid_files", "elements", "fixed", "front"])


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(final: str, *needs: str) -> str:
    names = _order(list(needs))
    if not names:
        return final.strip()
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in names]
    return "WITH\n" + ",\n".join(parts) + "\n" + final.strip()


ELEMENT_COLS = ("CAST(top_tag AS BIGINT) AS top_tag, CAST(item AS BIGINT) AS item, "
                "CAST(tag AS BIGINT) AS tag, keyword, vr, value")

ORACLES: dict[str, str] = {}


def oracle(name: str, final: str, *needs: str) -> None:
    ORACLES[name] = sql(final, *needs)


oracle("deidentify", f"SELECT path, out_path, study_id, {ELEMENT_COLS} FROM deid_elements", "deid_elements")

oracle("deidentify_paths", f"""
SELECT path, out_path, study_id, {ELEMENT_COLS} FROM (
  SELECT * REPLACE (CASE WHEN top_tag = 528656 AND item = 0 AND tag = 524320 THEN '19000101'
      WHEN top_tag = 1358954512 AND item = -1 THEN 'gone' ELSE value END AS value)
  FROM deid_elements WHERE NOT (top_tag = 528656 AND item = 0 AND tag = 2097165)) t""", "deid_elements")

# ---- scan, screening ---------------------------------------------------------
oracle("scan_inventory", """
SELECT root, CAST(count(*) AS BIGINT) AS n_files,
  CAST(count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS BIGINT) AS n_dirs
FROM inst GROUP BY root""", "inst")

oracle("scan_tree", """
SELECT root, count(*) AS n_files, CAST(count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS BIGINT) AS n_dirs,
  CAST(sum(128 + 4 + length(event_type)) AS BIGINT) AS n_bytes,
  count(*) FILTER (event_id % 97 = 0) AS n_skiplist,
  count(*) FILTER (event_id % 97 <> 0 AND magic <> 'DICM') AS n_not_dicom,
  count(*) FILTER (event_id % 97 <> 0 AND magic = 'DICM') AS n_candidate
FROM inst GROUP BY root""", "inst")

oracle("output_path", """
SELECT path, root || '-anon' || substr(path, length(root) + 1) AS out_path FROM inst""", "inst")

oracle("file_outcomes", "SELECT path, root, outcome, message FROM outcomes", "outcomes")

cte("presence", """
  SELECT path,
    bool_or(item = -1 AND tag = 1048608) AS has_pid, bool_or(item = -1 AND tag = 1048592) AS has_pname,
    bool_or(item = -1 AND tag = 524368) AS has_acc, bool_or(item = -1 AND tag = 2097165) AS has_uid,
    bool_or(item = -1 AND tag = 524320) AS has_date
  FROM elements GROUP BY path""", ["elements"])

oracle("tag_warnings", """
SELECT path, missing_tags, n_missing FROM (
  SELECT p.path,
    concat_ws(' ', CASE WHEN NOT has_pid THEN 'PatientID' END, CASE WHEN NOT has_pname THEN 'PatientName' END,
              CASE WHEN NOT has_acc THEN 'AccessionNumber' END, CASE WHEN NOT has_uid THEN 'StudyInstanceUID' END,
              CASE WHEN NOT has_date THEN 'StudyDate' END) AS missing_tags,
    CAST((NOT has_pid)::INT + (NOT has_pname)::INT + (NOT has_acc)::INT + (NOT has_uid)::INT
         + (NOT has_date)::INT AS BIGINT) AS n_missing
  FROM presence p JOIN outcomes o ON o.path = p.path WHERE o.outcome IN ('no_uid', 'ok')) t
WHERE n_missing > 0""", "presence", "outcomes")

oracle("study_uid", "SELECT path, study_uid FROM uids", "uids")

oracle("header_pivot", """
SELECT path, patient_name, patient_id, accession_number, study_date, study_time,
  top_study_uid AS study_uid, study_description FROM top_vals""", "top_vals")

# ---- scrub rules alone -----------------------------------------------------------
oracle("scrub_private", f"""
SELECT path, {ELEMENT_COLS} FROM elements
WHERE (top_tag // 65536) % 2 = 0 AND (tag // 65536) % 2 = 0""", "elements")

oracle("scrub_curves", f"""
SELECT path, {ELEMENT_COLS} FROM elements
WHERE ((top_tag // 65536) & 65280) <> 20480 AND ((tag // 65536) & 65280) <> 20480""", "elements")

oracle("scrub_sequence", f"""
SELECT path, {ELEMENT_COLS} FROM elements WHERE top_tag <> 4194933 AND tag <> 4194933""", "elements")

oracle("scrub_vr", """
SELECT path, CAST(top_tag AS BIGINT) AS top_tag, CAST(item AS BIGINT) AS item, CAST(tag AS BIGINT) AS tag,
  keyword, vr, CASE vr WHEN 'PN' THEN 'anonymous' WHEN 'DA' THEN '' WHEN 'TM' THEN '' ELSE value END AS value
FROM elements""", "elements")

oracle("scrub_fixed", f"""
SELECT path, {ELEMENT_COLS} FROM elements WHERE top_tag NOT IN ({FIXED_TAGS})
UNION ALL
SELECT i.path, CAST(x.tag AS BIGINT), CAST(-1 AS BIGINT), CAST(x.tag AS BIGINT), x.keyword, x.vr,
  CASE x.keyword WHEN 'PatientID' THEN 'research' WHEN 'PatientName' THEN 'Anon' ELSE x.value END
FROM inst i, fixed x""", "elements", "inst", "fixed")

# ---- registry ----------------------------------------------------------------------
oracle("study_new", "SELECT study_uid, path AS first_path FROM new_studies", "new_studies")

oracle("study_lookup", """
SELECT f.path, f.study_uid, r.row_no, r.study_id FROM ok_files f LEFT JOIN reg_index r ON f.study_uid = r.study_uid""",
       "ok_files", "reg_index")

oracle("study_assign", """
SELECT study_uid, k, row_no, study_id, over_pool, patient_name, patient_id, accession_number,
  study_date, study_time, study_description, first_path FROM assignments""", "assignments")

oracle("first_free_slot", "SELECT first_free_row FROM first_free", "first_free")

oracle("registry_index", """
SELECT study_uid, CAST(max(row_no) AS BIGINT) AS row_no, arg_max(study_id, row_no) AS study_id
FROM pool_dup WHERE study_id IS NOT NULL AND patient_id IS NOT NULL AND study_uid IS NOT NULL
GROUP BY study_uid""", "pool_dup")

oracle("registry_check", """
SELECT 'n_study_ids' AS "check", (SELECT n_study_ids FROM front) AS value
UNION ALL SELECT 'n_rows', CAST(count(*) AS BIGINT) FROM pool_gap
UNION ALL SELECT 'n_assigned', CAST(count(*) FILTER (WHERE study_id IS NOT NULL AND patient_id IS NOT NULL) AS BIGINT) FROM pool_gap
UNION ALL SELECT 'n_known_studies', CAST(count(DISTINCT study_uid) FILTER (WHERE study_id IS NOT NULL AND patient_id IS NOT NULL) AS BIGINT) FROM pool_gap
UNION ALL SELECT 'first_free_row', CAST(coalesce(min(row_no) FILTER (WHERE NOT (study_id IS NOT NULL AND patient_id IS NOT NULL)
    AND row_no BETWEEN 2 AND (SELECT n_study_ids + 1 FROM front)), (SELECT n_study_ids + 2 FROM front)) AS BIGINT) FROM pool_gap
UNION ALL SELECT 'first_gap_row', CAST(CASE WHEN ff < ma THEN ff END AS BIGINT) FROM (
    SELECT min(row_no) FILTER (WHERE NOT (study_id IS NOT NULL AND patient_id IS NOT NULL)
      AND row_no BETWEEN 2 AND (SELECT n_study_ids + 1 FROM front)) AS ff,
      max(row_no) FILTER (WHERE study_id IS NOT NULL AND patient_id IS NOT NULL) AS ma FROM pool_gap) t
UNION ALL SELECT 'n_missing_ids', CAST(count(*) FILTER (WHERE row_no BETWEEN 2 AND (SELECT n_study_ids + 1 FROM front)
    AND coalesce(study_id, '') = '') AS BIGINT) FROM pool_gap
UNION ALL SELECT 'n_missing_rows', CAST((SELECT n_study_ids FROM front)
    - count(*) FILTER (WHERE row_no BETWEEN 2 AND (SELECT n_study_ids + 1 FROM front)) AS BIGINT) FROM pool_gap
UNION ALL SELECT 'n_dup_uids', CAST(count(*) AS BIGINT) FROM (
    SELECT study_uid FROM pool_gap WHERE study_id IS NOT NULL AND patient_id IS NOT NULL AND study_uid IS NOT NULL
    GROUP BY study_uid HAVING count(*) > 1) t
UNION ALL SELECT 'n_dup_ids', CAST(count(*) AS BIGINT) FROM (
    SELECT study_id FROM pool_gap WHERE study_id IS NOT NULL GROUP BY study_id HAVING count(*) > 1) t""",
       "pool_gap", "front")

cte("committed", """
  SELECT p.row_no, p.study_id,
    CASE WHEN a.study_uid IS NOT NULL THEN a.patient_id ELSE p.patient_id END AS patient_id,
    CASE WHEN a.study_uid IS NOT NULL THEN a.study_uid ELSE p.study_uid END AS study_uid,
    CASE WHEN a.study_uid IS NOT NULL THEN a.patient_name END AS patient_name,
    CASE WHEN a.study_uid IS NOT NULL THEN a.accession_number END AS accession_number,
    CASE WHEN a.study_uid IS NOT NULL THEN a.study_date END AS study_date,
    CASE WHEN a.study_uid IS NOT NULL THEN a.study_time END AS study_time,
    CASE WHEN a.study_uid IS NOT NULL THEN a.study_description END AS study_description
  FROM pool p LEFT JOIN (SELECT * FROM assignments WHERE study_id IS NOT NULL) a ON p.row_no = a.row_no""",
    ["pool", "assignments"])

oracle("registry_commit", """
SELECT row_no, study_id, patient_id, study_uid, patient_name, accession_number, study_date, study_time,
  study_description FROM committed""", "committed")

oracle("reidentify", """
SELECT d.path, d.study_id, c.patient_id AS original_patient_id, c.study_uid AS original_study_uid
FROM deid_files d JOIN committed c ON c.study_id = d.study_id
WHERE c.patient_id IS NOT NULL""", "deid_files", "committed")

# two runs: files before the cutoff, then all files against the updated registry
cte("inc_ok1", """
  SELECT f.* FROM ok_files f JOIN inst i ON i.path = f.path WHERE i.ts < TIMESTAMP '2024-01-16 00:00:00'""",
    ["ok_files", "inst"])
cte("inc_new1", """
  SELECT study_uid, root_ord, path FROM (
    SELECT study_uid, root_ord, path, row_number() OVER (PARTITION BY study_uid ORDER BY root_ord, path) AS rn
    FROM inc_ok1) t
  WHERE rn = 1 AND study_uid NOT IN (SELECT study_uid FROM reg_index)""", ["inc_ok1", "reg_index"])
cte("inc_a1", """
  SELECT n.study_uid, f.row_no, f.study_id
  FROM (SELECT *, row_number() OVER (ORDER BY root_ord, path, study_uid) AS k FROM inc_new1) n LEFT JOIN free f ON f.k = n.k""",
    ["inc_new1", "free"])
cte("inc_index1", """
  SELECT study_uid FROM reg_index UNION ALL SELECT study_uid FROM inc_a1 WHERE study_id IS NOT NULL""",
    ["reg_index", "inc_a1"])
cte("inc_free", """
  SELECT row_no, study_id, row_number() OVER (ORDER BY row_no) AS k
  FROM free WHERE row_no NOT IN (SELECT row_no FROM inc_a1 WHERE row_no IS NOT NULL)""", ["free", "inc_a1"])
cte("inc_new2", """
  SELECT study_uid, root_ord, path FROM (
    SELECT study_uid, root_ord, path, row_number() OVER (PARTITION BY study_uid ORDER BY root_ord, path) AS rn
    FROM ok_files) t
  WHERE rn = 1 AND study_uid NOT IN (SELECT study_uid FROM inc_index1)""", ["ok_files", "inc_index1"])
cte("inc_a2", """
  SELECT n.study_uid, f.row_no, f.study_id
  FROM (SELECT *, row_number() OVER (ORDER BY root_ord, path, study_uid) AS k FROM inc_new2) n LEFT JOIN inc_free f ON f.k = n.k""",
    ["inc_new2", "inc_free"])

oracle("incremental_assign", """
SELECT study_uid, CAST(row_no AS BIGINT) AS row_no, study_id, 1 AS run FROM inc_a1
UNION ALL SELECT study_uid, CAST(row_no AS BIGINT), study_id, 2 FROM inc_a2""", "inc_a1", "inc_a2")

oracle("incremental_files", """
SELECT path, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'changed' ELSE 'new' END AS status
FROM inst WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' OR user_id % 7 = 0""", "inst")

oracle("output_current", """
SELECT i.path, i.root || '-anon' || substr(i.path, length(i.root) + 1) AS out_path,
  CASE WHEN i.ts < TIMESTAMP '2024-01-16 00:00:00' AND i.root = 'root1' THEN 'r3'
    WHEN i.ts >= TIMESTAMP '2024-01-16 00:00:00' OR i.user_id % 7 = 0 THEN 'r2' ELSE 'r1' END AS run_id, e.n_elements
FROM inst i JOIN (SELECT path, CAST(count(*) AS BIGINT) AS n_elements FROM elements GROUP BY path) e ON e.path = i.path""", "inst", "elements")

oracle("registry_buckets", """
SELECT study_uid, CAST(row_no AS BIGINT) AS row_no, study_id, 1 AS run FROM inc_a1
UNION ALL SELECT study_uid, CAST(row_no AS BIGINT), study_id, 2 FROM inc_a2""", "inc_a1", "inc_a2")

oracle("reidentify_ids", """
SELECT DISTINCT d.study_id, c.patient_id AS original_patient_id, c.study_uid AS original_study_uid
FROM deid_files d JOIN committed c ON c.study_id = d.study_id
WHERE c.patient_id IS NOT NULL""", "deid_files", "committed")

# ---- study ID pool -----------------------------------------------------------------
cte("pool_req", f"""
  SELECT n, w, 676 * {power('w')} AS cap
  FROM (SELECT n, {digits('n')} AS w FROM (SELECT CAST(count(DISTINCT study_uid) AS BIGINT) AS n FROM ok_files))""",
    ["ok_files"])
cte("pool_draws", f"""
  SELECT code, min(draw) AS first_draw, any_value(w) AS w FROM (
    SELECT draw, w, {drawn('cap')} AS code FROM (SELECT unnest(range(2 * n + 64)) AS draw, cap, w FROM pool_req) d) t
  GROUP BY code""", ["pool_req"])
cte("new_pool", """
  SELECT code, w, first_draw, row_number() OVER (ORDER BY first_draw) AS idx FROM pool_draws
  QUALIFY idx <= (SELECT n FROM pool_req)""", ["pool_draws", "pool_req"])

oracle("id_pool", f"""
SELECT CAST(idx + 1 AS BIGINT) AS row_no, {decoded('code', 'w')} AS study_id FROM new_pool""", "new_pool")

# the permutation: six rounds on two digits of base a, again while the number lies outside
_ROUND = ("lambda st, rd: {'l': st.r, 'r': (st.l + CAST('0x' || substr(sha256(concat('k::', CAST(rd.l AS VARCHAR), ':', CAST(st.r AS VARCHAR))), 1, 12) AS BIGINT)) % a}")
cte("perm_req", "SELECT n, w, cap, CAST(ceil(sqrt(cap)) AS BIGINT) AS a FROM pool_req", ["pool_req"])
_STATE = "list_reduce([{rounds}], {step}, {{'l': {x} // a, 'r': {x} % a}})".format(
    rounds=", ".join(f"{{'l': CAST({i} AS BIGINT), 'r': CAST(0 AS BIGINT)}}" for i in range(6)), step=_ROUND, x="x")
for _walk in range(5):  # walks of more steps do not occur at these sizes: the last step would leave rows without an ID
    _source = "(SELECT i, w, cap, a, i AS x FROM (SELECT unnest(range(2 * n)) AS i, w, cap, a FROM perm_req))" if _walk == 0 else f"perm_{_walk - 1}"
    _value = "s.l * a + s.r" if _walk == 0 else "CASE WHEN x < cap THEN x ELSE s.l * a + s.r END"
    cte(f"perm_{_walk}", f"SELECT i, w, cap, a, {_value} AS x FROM (SELECT *, {_STATE} AS s FROM {_source})", ["perm_req"] if _walk == 0 else [f"perm_{_walk - 1}"])
oracle("id_pool_permuted", f"""
SELECT CAST(i + 2 AS BIGINT) AS row_no, CASE WHEN x < cap THEN {decoded('x', 'w')} END AS study_id FROM perm_4""", "perm_4")

oracle("id_pool_stats", """
SELECT (SELECT n FROM pool_req) AS n_requested, (SELECT CAST(cap AS VARCHAR) FROM pool_req) AS capacity,
  CAST(count(*) AS BIGINT) AS n_ids, CAST(count(DISTINCT code) AS BIGINT) AS n_distinct,
  CAST(max(first_draw) + 1 AS BIGINT) AS draws_used, CAST(max(first_draw) + 1 - count(*) AS BIGINT) AS collisions
FROM new_pool""", "new_pool", "pool_req")

# three quarters of all IDs that as many digits as the studies have can give
cte("full_req", f"""
  SELECT w, {power('w')} AS cap, {power('w')} * 3 // 4 AS n FROM (SELECT CAST(length(CAST(n AS VARCHAR)) AS INTEGER) AS w FROM pool_req)""",
    ["pool_req"])
oracle("id_pool_full", f"""
SELECT CAST(idx + 1 AS BIGINT) AS row_no, study_id FROM (
  SELECT lpad(CAST(code AS VARCHAR), w, '0') AS study_id, row_number() OVER (ORDER BY first_draw) AS idx FROM (
    SELECT code, any_value(w) AS w, min(draw) AS first_draw FROM (
      SELECT w, draw, {drawn('cap')} AS code FROM (SELECT unnest(range(3 * cap + 200)) AS draw, cap, w FROM full_req)) GROUP BY code))
WHERE idx <= (SELECT n FROM full_req)""", "full_req")

# thirteen letters: eight from the first hash, five from the second
_WIDE_FIRST, _WIDE_SECOND = "uuuuuddd", "ddddd"
oracle("id_pool_wide", f"""
SELECT CAST(draw + 2 AS BIGINT) AS row_no,
  concat({', '.join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((a // {26 ** (4 - i) * 1000}) % 26 AS INT) + 1, 1)" for i in range(5))},
         lpad(CAST(a % 1000 AS VARCHAR), 3, '0'), lpad(CAST(b AS VARCHAR), 5, '0')) AS study_id
FROM (SELECT draw, {drawn(str(26 ** 5 * 1000))} AS a, {drawn('100000', group='/1')} AS b
      FROM (SELECT unnest(range(n)) AS draw FROM pool_req))""", "pool_req")

cte("ext_req", f"""
  SELECT k, w, 676 * {power('w')} AS cap FROM (
    SELECT CAST(count(*) AS BIGINT) AS k, {digits('(SELECT slots FROM pool_sizes)')} AS w FROM new_studies)""",
    ["new_studies", "pool_sizes"])
cte("ext_codes", f"""
  SELECT code, min(draw) AS first_draw, {decoded('code', 'any_value(w)')} AS study_id
  FROM (SELECT draw, w, {drawn('cap')} AS code
        FROM (SELECT unnest(range(2 * (k + (SELECT count(*) FROM pool)) + 64)) AS draw, cap, w FROM ext_req) d) t
  GROUP BY code""", ["ext_req", "pool"])
cte("extension", """
  SELECT CAST(rn + (SELECT max(row_no) FROM pool) AS BIGINT) AS row_no, study_id FROM (
    SELECT study_id, row_number() OVER (ORDER BY first_draw) AS rn FROM ext_codes
    WHERE study_id NOT IN (SELECT study_id FROM pool WHERE study_id IS NOT NULL)) t
  WHERE rn <= (SELECT k FROM ext_req)""", ["ext_codes", "ext_req", "pool"])

oracle("id_pool_extend", "SELECT row_no, study_id FROM extension", "extension")

# a registry whose nominal size ends in the middle of its slots; past that, every third slot is in use
cte("over_pool", """
  SELECT row_no, study_id, CASE WHEN used THEN concat('Q', row_no) ELSE patient_id END AS patient_id,
    CASE WHEN used THEN concat('9.9.', row_no) ELSE study_uid END AS study_uid
  FROM (SELECT *, patient_id IS NULL AND row_no > (SELECT n_study_ids // 2 + 1 FROM front) AND row_no % 3 = 0 AS used FROM pool)""",
    ["pool", "front"])
cte("over_free", """
  SELECT row_no, study_id, row_number() OVER (ORDER BY row_no) AS k FROM over_pool WHERE patient_id IS NULL""", ["over_pool"])
oracle("study_assign_over_pool", """
SELECT n.study_uid, n.k, f.row_no, f.study_id, coalesce(f.row_no > (SELECT n_study_ids // 2 + 1 FROM front), false) AS over_pool
FROM (SELECT *, CAST(row_number() OVER (ORDER BY root_ord, path, study_uid) AS BIGINT) AS k FROM new_studies) n
LEFT JOIN over_free f ON f.k = n.k""", "new_studies", "over_free", "front")

# the same registry after an extension by one ID for each new study; everyone finds a slot
cte("ext_free", """
  SELECT study_id, row_number() OVER (ORDER BY row_no) AS k
  FROM (SELECT row_no, study_id FROM over_pool WHERE patient_id IS NULL UNION ALL SELECT row_no, study_id FROM extension)""",
    ["over_pool", "extension"])
oracle("reidentify_after_extend", """
SELECT f.path, a.study_id, a.patient_id AS original_patient_id, f.study_uid AS original_study_uid
FROM ok_files f JOIN (
  SELECT n.study_uid, e.study_id, v.patient_id
  FROM (SELECT *, row_number() OVER (ORDER BY root_ord, path, study_uid) AS k FROM new_studies) n
  JOIN ext_free e ON e.k = n.k JOIN top_vals v ON v.path = n.path
  UNION ALL SELECT study_uid, study_id, patient_id FROM over_pool WHERE patient_id IS NOT NULL) a ON a.study_uid = f.study_uid""",
       "ok_files", "new_studies", "ext_free", "top_vals", "over_pool")

oracle("mask_capacity", """
SELECT root, mask, prefix, suffix, n, valid, CAST(cap AS VARCHAR) AS capacity, CAST(id_length AS BIGINT) AS id_length,
  id_length > 16 AS too_long,
  CASE WHEN NOT valid THEN 'invalid' WHEN n > cap THEN 'impossible' WHEN n > 0.98 * cap THEN 'slow' ELSE 'ok' END AS status
FROM (
  SELECT r.root, p.mask, p.prefix, p.suffix, r.n, p.valid, p.cap, p.id_length FROM (
    SELECT root, CAST(count(DISTINCT study_uid) AS BIGINT) AS n FROM ok_files GROUP BY root) r
  LEFT JOIN (VALUES ('root0', 'uudddd', '', '', true, 6760000, 6),
                    ('root1', 'ldd', 'TEST-', 'END', true, 2600, 11),
                    ('root2', 'd', '', '', true, 10, 1)) AS p(root, mask, prefix, suffix, valid, cap, id_length)
  ON r.root = p.root) t""", "ok_files")

oracle("study_create", """
SELECT 'Fixture study' AS study_title, 'Fixture PI' AS pi, 'IRBcode1234' AS irb_code,
  CAST(count(DISTINCT study_uid) AS BIGINT) AS n_study_ids, 'test_filev1' AS registry_name FROM ok_files""",
       "ok_files")

oracle("text_valid", """
SELECT 'part' AS source, p_partkey AS key, p_name AS text, regexp_matches(replace(p_name, ' ', ''), '^\\p{L}+$') AS is_valid FROM part
UNION ALL
SELECT 'customer', c_custkey, c_name, regexp_matches(replace(c_name, ' ', ''), '^\\p{L}+$') FROM customer""")

# ---- pixels ------------------------------------------------------------------------
cte("pix_a", """
  SELECT vec_id AS pair_id, pos AS i, CAST(floor(CAST(x AS DOUBLE) * 100) AS INT) AS a,
    CASE WHEN vec_id % 5 = 0 THEN 12 ELSE 8 END AS w, n
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos, len(embedding) AS n FROM embeddings) t""")
cte("pix_b", """
  SELECT *, CASE WHEN pair_id % 3 = 0 AND (pair_id + i) % 37 = 0 THEN a + 1 ELSE a END AS b FROM pix_a""", ["pix_a"])
# both images by row and column
cte("pix", """
  SELECT coalesce(l.pair_id, g.pair_id) AS pair_id, coalesce(l.r, g.r) AS r, coalesce(l.c, g.c) AS c, l.a, g.b,
    coalesce(l.r, g.r) * greatest(8, coalesce(l.w, g.w)) + coalesce(l.c, g.c) AS i
  FROM (SELECT pair_id, i // 8 AS r, i % 8 AS c, a, w FROM pix_b) l
  FULL JOIN (SELECT pair_id, i // w AS r, i % w AS c, b, w FROM pix_b) g ON l.pair_id = g.pair_id AND l.r = g.r AND l.c = g.c""", ["pix_b"])

oracle("pixel_diff", """
SELECT pair_id, CAST(i AS BIGINT) AS i, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, a, b
FROM pix WHERE a IS DISTINCT FROM b""", "pix")

oracle("pixel_stats", """
SELECT pair_id, CAST(count(*) AS BIGINT) AS n_pixels, CAST(count(*) FILTER (WHERE a IS DISTINCT FROM b) AS BIGINT) AS n_mismatch,
  min(a) AS min_a, max(a) AS max_a, min(b) AS min_b, max(b) AS max_b
FROM pix GROUP BY pair_id""", "pix")

oracle("pixel_equal", """
SELECT pair_id, any_value(w) = 8 AS header_shape_equal, any_value(w) = 8 AS array_shape_equal,
  any_value(w) = 8 AND bool_and(a = b) AS pixels_equal
FROM pix_b GROUP BY pair_id""", "pix_b")

oracle("pixel_stats_tiled", """
SELECT p.*, e.header_shape_equal, e.array_shape_equal, e.pixels_equal
FROM (SELECT pair_id, CAST(count(*) AS BIGINT) AS n_pixels, CAST(count(*) FILTER (WHERE a IS DISTINCT FROM b) AS BIGINT) AS n_mismatch,
    min(a) AS min_a, max(a) AS max_a, min(b) AS min_b, max(b) AS max_b FROM pix GROUP BY pair_id) p
JOIN (SELECT pair_id, any_value(w) = 8 AS header_shape_equal, any_value(w) = 8 AS array_shape_equal, any_value(w) = 8 AND bool_and(a = b) AS pixels_equal
  FROM pix_b GROUP BY pair_id) e ON e.pair_id = p.pair_id""", "pix", "pix_b")

oracle("pixel_diff_tiled", """
SELECT pair_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, a, b FROM pix WHERE a IS DISTINCT FROM b""", "pix")

# ---- tag edits, dump, log, report --------------------------------------------------
cte("patches", """
  SELECT concat('P', c_custkey) AS patient_id,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('NEW', c_custkey) END AS new_accession,
    CASE WHEN c_custkey % 4 = 0 THEN concat('Q', c_custkey) END AS new_patient_id,
    CASE WHEN c_custkey % 5 = 0 THEN '20200101' ELSE '' END AS new_study_date FROM customer""")

oracle("tag_patch", """
SELECT t.path, t.patient_id, t.acc AS accession_before,
  CASE WHEN p.new_accession <> '' THEN p.new_accession ELSE t.acc END AS accession_after
FROM (SELECT path, max(value) FILTER (WHERE item = -1 AND tag = 1048608) AS patient_id,
             max(value) FILTER (WHERE item = -1 AND tag = 524368) AS acc
      FROM elements GROUP BY path) t
JOIN patches p ON p.patient_id = t.patient_id""", "elements", "patches")

oracle("tag_edit_all", """
SELECT t.path, t.patient_id, p.patient_id IS NOT NULL AS has_patch,
  CASE WHEN coalesce(p.new_patient_id, '') <> '' THEN p.new_patient_id ELSE t.patient_id END AS patient_id_after,
  CASE WHEN coalesce(p.new_accession, '') <> '' THEN p.new_accession ELSE t.acc END AS accession_after,
  CASE WHEN coalesce(p.new_study_date, '') <> '' THEN p.new_study_date ELSE t.day END AS study_date_after
FROM (SELECT path, max(value) FILTER (WHERE item = -1 AND tag = 1048608) AS patient_id,
             max(value) FILTER (WHERE item = -1 AND tag = 524368) AS acc,
             max(value) FILTER (WHERE item = -1 AND tag = 524320) AS day
      FROM elements GROUP BY path) t
LEFT JOIN patches p ON p.patient_id = t.patient_id""", "elements", "patches")

cte("set_patches", """
  SELECT concat('P', c_custkey) AS patient_id, concat('SET', c_custkey) AS new_value, c_custkey % 2 = 0 AS active FROM customer""")
cte("set_files", """
  SELECT path, max(value) FILTER (WHERE item = -1 AND tag = 1048608) AS patient_id,
    bool_or(item = -1 AND tag = 524368) AS has_acc
  FROM elements GROUP BY path""", ["elements"])

oracle("tag_set", """
SELECT f.path, f.patient_id, CASE WHEN NOT s.active THEN 'inactive' WHEN f.has_acc THEN 'set' ELSE 'absent' END AS status,
  CASE WHEN s.active AND f.has_acc THEN s.new_value END AS value
FROM set_files f JOIN set_patches s ON s.patient_id = f.patient_id
UNION ALL
SELECT NULL, s.patient_id, 'no_file', NULL FROM set_patches s
WHERE s.patient_id NOT IN (SELECT patient_id FROM set_files WHERE patient_id IS NOT NULL)""",
       "set_files", "set_patches")

# names: the keyword's words, but for the names that differ from them
_NAMES = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in model.ELEMENT_NAMES.items())
_NAME = (f"CASE e.keyword {_NAMES} ELSE regexp_replace(regexp_replace(e.keyword, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
         "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') END")

oracle("header_dump", f"""
SELECT e.path, e.path || '.hdr.txt' AS out_path,
  string_agg(CASE WHEN e.item >= 0 THEN '  ' ELSE '' END ||
    printf('(%04X,%04X) %-35s %s: %s', e.tag // 65536, e.tag % 65536,
      CASE WHEN coalesce(e.keyword, '') <> '' THEN {_NAME}
           WHEN (e.tag // 65536) % 2 = 1 THEN 'Private tag data' ELSE 'Unknown tag' END,
      e.vr, coalesce(e.value, '')), chr(10) ORDER BY e.top_tag, e.item, e.tag) AS text
FROM elements e JOIN inst i ON i.path = e.path WHERE i.parse_error IS NULL
GROUP BY e.path""", "elements", "inst")

oracle("header_dump_failures", """
SELECT path, regexp_extract(path, '([^/]*)$', 1) || ': no header dump: ' || parse_error AS message FROM inst WHERE parse_error IS NOT NULL""", "inst")

oracle("audit_log", """
SELECT CAST(row_number() OVER (ORDER BY ts, path) AS BIGINT) AS seq, strftime(ts, '%d-%m-%Y') AS log_date,
  strftime(ts, '%H:%M:%S') AS log_time, level,
  '(' || CASE level WHEN 1 THEN '' WHEN 2 THEN 'High' ELSE 'DEBUG' END || '): ' || message AS activity,
  'fixture-user' AS "user", 'fixture-host' AS computer
FROM (
  SELECT i.ts, o.path,
    CAST(CASE WHEN o.outcome IN ('skiplist', 'not_dicom', 'unreadable') THEN 1 WHEN o.outcome = 'no_uid' THEN 2 ELSE 3 END AS INTEGER) AS level,
    coalesce(o.message, 'De-identified ' || o.fname) AS message
  FROM outcomes o JOIN inst i ON i.path = o.path) t
WHERE level <= 2""", "outcomes", "inst")

oracle("run_report", """
SELECT root, grouping(root) = 1 AS is_total, CAST(count(*) AS BIGINT) AS n_files,
  CAST(count(DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1)) AS BIGINT) AS n_dirs,
  CAST(count(*) FILTER (WHERE outcome IN ('no_uid', 'ok', 'exhausted')) AS BIGINT) AS n_valid,
  CAST(count(*) FILTER (WHERE outcome IN ('skiplist', 'no_uid')) AS BIGINT) AS n_skipped,
  CAST(count(*) FILTER (WHERE outcome IN ('not_dicom', 'unreadable')) AS BIGINT) AS n_non_dicom,
  CAST(count(*) FILTER (WHERE outcome = 'ok') AS BIGINT) AS n_anonymised,
  CAST(count(*) FILTER (WHERE outcome = 'exhausted') AS BIGINT) AS n_exhausted
FROM final_outcomes GROUP BY ROLLUP (root)""", "final_outcomes")

oracle("outcome_summary", """
SELECT outcome, CAST(count(*) AS BIGINT) AS n_files, CAST(count(DISTINCT root) AS BIGINT) AS n_roots,
  min(message) AS first_message, max(message) AS last_message
FROM final_outcomes GROUP BY outcome""", "final_outcomes")

oracle("header_table", f"SELECT path, {ELEMENT_COLS} FROM elements", "elements")


# ---- volume corpus: lineitem rows as files ------------------------------------------
cte("v_inst", """
  SELECT concat('root', l_returnflag) AS root,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS root_ord,
    concat('root', l_returnflag, '/o', l_orderkey, '/l', l_linenumber, '_', l_partkey, '_', l_suppkey, '.dcm') AS path,
    CASE WHEN l_orderkey % 3 = 0 THEN '2.25.0' ELSE concat('2.25.', l_orderkey) END AS uid,
    l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_shipdate
  FROM lineitem""")

# kept original elements after the scrub (private, curve, request sequence and
# fixed top-level tags removed; PN/DA/TM replaced)
cte("v_kept", """
  SELECT uid, 'DA' AS vr, '' AS value FROM v_inst
  UNION ALL SELECT uid, 'TM', '' FROM v_inst
  UNION ALL SELECT uid, 'CS', 'CT' FROM v_inst
  UNION ALL SELECT uid, 'UI', uid FROM v_inst
  UNION ALL SELECT uid, 'DT', strftime(l_shipdate, '%Y%m%d%H%M%S') FROM v_inst""", ["v_inst"])

cte("v_firsts", """
  SELECT uid, root_ord, path FROM (
    SELECT uid, root_ord, path, row_number() OVER (PARTITION BY uid ORDER BY root_ord, path) AS rn FROM v_inst) t
  WHERE rn = 1""", ["v_inst"])

cte("v_req", f"""
  SELECT n, w, 676 * {power('w')} AS cap FROM (SELECT n, {digits('n')} AS w FROM (SELECT CAST(count(DISTINCT uid) AS BIGINT) AS n FROM v_inst))""",
    ["v_inst"])

cte("v_pool", f"""
  SELECT CAST(idx + 1 AS BIGINT) AS row_no, {decoded('code', 'w')} AS study_id
  FROM (
    SELECT code, w, row_number() OVER (ORDER BY first_draw) AS idx FROM (
      SELECT code, any_value(w) AS w, min(draw) AS first_draw FROM (
        SELECT draw, w, {drawn('cap')} AS code FROM (SELECT unnest(range(2 * n + 64)) AS draw, cap, w FROM v_req) d) t
      GROUP BY code) c
    QUALIFY idx <= (SELECT n FROM v_req)) p""", ["v_req"])

cte("v_assign", """
  SELECT f.uid, p.study_id FROM (
    SELECT uid, row_number() OVER (ORDER BY root_ord, path, uid) + 1 AS row_no FROM v_firsts) f
  JOIN v_pool p ON p.row_no = f.row_no""", ["v_firsts", "v_pool"])

# characters of the constant upserted values (PatientID / PatientName are per file)
fixed_const_chars = sum(len(f.value) for f in model.FIXED_ASSIGNMENTS
                        if f.value not in (model.STUDY_ID_VALUE, model.PATIENT_NAME_VALUE))

oracle("deidentify_volume", f"""
SELECT a.study_id, f.n_files,
  CAST(k.n_kept + {len(model.FIXED_ASSIGNMENTS)} * f.n_files AS BIGINT) AS n_elements,
  CAST(k.chars + f.n_files * ({fixed_const_chars} + length(a.study_id) + length('IRB-V')) AS BIGINT) AS value_chars
FROM v_assign a
JOIN (SELECT uid, CAST(count(*) AS BIGINT) AS n_files FROM v_inst GROUP BY uid) f ON f.uid = a.uid
JOIN (SELECT uid, count(*) AS n_kept, sum(length(value)) AS chars FROM v_kept GROUP BY uid) k ON k.uid = a.uid""",
       "v_assign", "v_inst", "v_kept")


# the same scrub with the request-attributes sequence kept (rule table without drop_tag)
cte("deid_elements_literal", f"""
  SELECT d.path, d.out_path, d.study_id, e.top_tag, e.item, e.tag, e.keyword, e.vr,
    CASE e.vr WHEN 'PN' THEN 'anonymous' WHEN 'DA' THEN '' WHEN 'TM' THEN '' ELSE e.value END AS value
  FROM deid_files d JOIN elements e ON d.path = e.path
  WHERE (e.top_tag // 65536) % 2 = 0 AND (e.tag // 65536) % 2 = 0
    AND ((e.top_tag // 65536) & 65280) <> 20480 AND ((e.tag // 65536) & 65280) <> 20480
    AND e.top_tag NOT IN ({FIXED_TAGS})
  UNION ALL
  SELECT d.path, d.out_path, d.study_id, x.tag, -1, x.tag, x.keyword, x.vr,
    CASE x.keyword WHEN 'PatientID' THEN d.study_id WHEN 'PatientName' THEN (SELECT irb_code FROM front)
                   ELSE x.value END
  FROM deid_files d, fixed x""", ["deid_files", "elements", "fixed", "front"])

oracle("deidentify_rules", f"SELECT path, out_path, study_id, {ELEMENT_COLS} FROM deid_elements_literal",
       "deid_elements_literal")
