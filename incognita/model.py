"""Schemas and fixed values of the de-identification engine.

A tag is one BIGINT: ``group * 65536 + element`` (so 0x0020000D = 2097165).
A header is one row per file holding every data element in preorder:

    elements ARRAY<STRUCT<pos ARRAY<BIGINT>, path_tags ARRAY<BIGINT>,
                          keyword STRING, vr STRING, value STRING>>

``pos`` interleaves tags and item numbers (tag, item, tag, ..., tag), so array
comparison puts a sequence before its items and ``array_sort`` restores
preorder. ``path_tags`` holds only the tags, top level first; depth is
``size(path_tags) - 1``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def tag(group: int, element: int) -> int:
    return group * 65536 + element


ELEMENT = T.StructType([
    T.StructField("pos", T.ArrayType(T.LongType(), False), False),
    T.StructField("path_tags", T.ArrayType(T.LongType(), False), False),
    T.StructField("keyword", T.StringType(), True),
    T.StructField("vr", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])

# Key columns are copied out of ``elements`` when a header table is written, so
# jobs that only need them (screening, study assignment, patches) read a few
# narrow Parquet columns instead of every element array.
KEY_COLUMNS = ["study_uid", "top_study_uid", "patient_name", "patient_id", "accession_number",
               "study_date", "study_time", "study_description"]

HEADERS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("root", T.StringType(), False),
    T.StructField("root_ord", T.IntegerType(), False),
    T.StructField("mtime", T.TimestampType(), True),
    T.StructField("magic", T.StringType(), True),
    T.StructField("parse_error", T.StringType(), True),
    *[T.StructField(c, T.StringType(), True) for c in KEY_COLUMNS],
    T.StructField("elements", T.ArrayType(ELEMENT, False), True),
])

# Registry tables (the "Data", "Front" and "Log" parts of a study registry).
SLOTS = T.StructType([
    T.StructField("row_no", T.LongType(), False),
    T.StructField("study_id", T.StringType(), True),
    T.StructField("assigned_at", T.TimestampType(), True),
    T.StructField("patient_name", T.StringType(), True),
    T.StructField("patient_id", T.StringType(), True),
    T.StructField("accession_number", T.StringType(), True),
    T.StructField("study_date", T.StringType(), True),
    T.StructField("study_time", T.StringType(), True),
    T.StructField("study_uid", T.StringType(), True),
    T.StructField("study_description", T.StringType(), True),
])

STUDY = T.StructType([
    T.StructField("study_title", T.StringType(), True),
    T.StructField("pi", T.StringType(), True),
    T.StructField("irb_code", T.StringType(), True),
    T.StructField("n_study_ids", T.LongType(), False),
])

AUDIT_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("activity", T.StringType(), True),
    T.StructField("user", T.StringType(), True),
    T.StructField("computer", T.StringType(), True),
])

# Image pairs before and after de-identification, row-major pixels.
PIXEL_PAIRS = T.StructType([
    T.StructField("pair_id", T.LongType(), False),
    T.StructField("a", T.ArrayType(T.IntegerType()), True),
    T.StructField("b", T.ArrayType(T.IntegerType()), True),
    T.StructField("a_rows", T.IntegerType(), True),
    T.StructField("a_cols", T.IntegerType(), True),
    T.StructField("b_rows", T.IntegerType(), True),
    T.StructField("b_cols", T.IntegerType(), True),
])

# Squares of an image's pixel grid, for images larger than a row or of several frames.
TILES = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("tile_row", T.IntegerType()),
    T.StructField("tile_col", T.IntegerType()),
    T.StructField("edge", T.IntegerType()),
    T.StructField("n_rows", T.IntegerType()),   # of the frame, as its header says
    T.StructField("n_cols", T.IntegerType()),
    T.StructField("width", T.IntegerType()),    # of this tile
    T.StructField("pixels", T.ArrayType(T.IntegerType())),
])

SLOT_VALUE_COLUMNS = ["patient_name", "patient_id", "accession_number",
                      "study_date", "study_time", "study_uid", "study_description"]

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference tool's values for the same
# results; they are listed plainly and in the reference's order.
# ---------------------------------------------------------------------------

# File names that are never processed (exact, case-sensitive).
SKIP_LIST = ["DICOMDIR", "VERSION", "LOCKFILE"]

# Top-level keywords whose absence is reported as a tag warning, in order.
TAG_CHECKLIST = ["PatientID", "PatientName", "AccessionNumber", "StudyInstanceUID", "StudyDate"]

# Bytes 128..131 of a DICOM file.
MAGIC = "DICM"
PREAMBLE_BYTES = 128

# Value-type scrub: PN values become 'anonymous', DA and TM values become ''.
VR_REPLACEMENTS = {"PN": "anonymous", "DA": "", "TM": ""}

# Curve groups 0x5000-0x50FF: (group & 0xFF00) == 0x5000.
CURVE_GROUP_MASK = 0xFF00
CURVE_GROUP_VALUE = 0x5000

# Default patient name / patient ID of the full de-identification.
DEFAULT_PATIENT_NAME = "Anon"
DEFAULT_PATIENT_ID = "research"

# IRB code written into a newly created registry.
DEFAULT_IRB_CODE = "IRBcode1234"

# Log levels and their labels.
LOG_NORMAL, LOG_HIGH, LOG_DEBUG = 1, 2, 3
LOG_LEVEL_TEXT = {LOG_NORMAL: "", LOG_HIGH: "High", LOG_DEBUG: "DEBUG"}

# Audit-log message formats (str.format fields in braces).
MSG_STUDY_CREATED = "New Study Created. Title: {title}, PI: {pi}"
MSG_POOL_CREATED = 'Number of studyIDs:{n} Prefix: "{prefix}" Format: "{mask}"{suffix}'
MSG_LAUNCHED = "Launched: Examining {inputs}"
MSG_COMPLETED = "Completed. Deidentified {ok}, failed {failed}"

# Study-ID pool defaults and mask alphabets (c = either case, u, l, d).
DEFAULT_POOL_SIZE = 1000
DEFAULT_MASK = "uudddd"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
MASK_ALPHABETS = {"c": LOWER + UPPER, "u": UPPER, "l": LOWER, "d": DIGITS}
SLOW_POOL_FRACTION = 0.98
MAX_ID_LENGTH = 16

# Placeholders for the two per-file values of the fixed assignments.
STUDY_ID_VALUE = "<study_id>"
PATIENT_NAME_VALUE = "<patient_name>"

# Tags used by name in the engine.
STUDY_DATE = tag(0x0008, 0x0020)
STUDY_TIME = tag(0x0008, 0x0030)
ACCESSION_NUMBER = tag(0x0008, 0x0050)
STUDY_DESCRIPTION = tag(0x0008, 0x1030)
PATIENT_NAME = tag(0x0010, 0x0010)
PATIENT_ID = tag(0x0010, 0x0020)
STUDY_INSTANCE_UID = tag(0x0020, 0x000D)
REQUEST_ATTRIBUTES_SEQUENCE = tag(0x0040, 0x0275)

# Top-level tag of each key column (study_uid is searched at every depth;
# top_study_uid is the top-level one, used only for presence checks).
KEY_TAGS = {
    "patient_name": PATIENT_NAME,
    "patient_id": PATIENT_ID,
    "accession_number": ACCESSION_NUMBER,
    "study_date": STUDY_DATE,
    "study_time": STUDY_TIME,
    "study_description": STUDY_DESCRIPTION,
}

# Key column holding the top-level value of each checklist keyword.
CHECKLIST_KEYS = {
    "PatientID": "patient_id",
    "PatientName": "patient_name",
    "AccessionNumber": "accession_number",
    "StudyInstanceUID": "top_study_uid",
    "StudyDate": "study_date",
}

KEYWORD_TAGS = {
    "StudyDate": STUDY_DATE,
    "StudyTime": STUDY_TIME,
    "AccessionNumber": ACCESSION_NUMBER,
    "StudyDescription": STUDY_DESCRIPTION,
    "PatientName": PATIENT_NAME,
    "PatientID": PATIENT_ID,
    "StudyInstanceUID": STUDY_INSTANCE_UID,
}


@dataclass(frozen=True)
class Fixed:
    keyword: str
    tag: int
    vr: str
    value: str


# The 24 top-level assignments of the full de-identification, in order.
# Tags and VRs are from the public DICOM data dictionary.
FIXED_ASSIGNMENTS = [
    Fixed("AccessionNumber", tag(0x0008, 0x0050), "SH", ""),
    Fixed("StudyID", tag(0x0020, 0x0010), "SH", ""),
    Fixed("InstitutionalDepartmentName", tag(0x0008, 0x1040), "LO", "St Elsewhere Radiology"),
    Fixed("InstitutionAddress", tag(0x0008, 0x0081), "ST", ""),
    Fixed("PatientID", tag(0x0010, 0x0020), "LO", STUDY_ID_VALUE),
    Fixed("PatientName", tag(0x0010, 0x0010), "PN", PATIENT_NAME_VALUE),
    Fixed("PatientBirthDate", tag(0x0010, 0x0030), "DA", ""),
    Fixed("InstitutionName", tag(0x0008, 0x0080), "LO", "St Elsewhere"),
    Fixed("StationName", tag(0x0008, 0x1010), "SH", "anon MRI Station"),
    Fixed("PerformedStationName", tag(0x0040, 0x0242), "SH", "anon MRI Station"),
    Fixed("PerformedLocation", tag(0x0040, 0x0243), "SH", "anon MRI Station"),
    Fixed("PerformedProcedureStepStartDate", tag(0x0040, 0x0244), "DA", ""),
    Fixed("PerformedProcedureStepStartTime", tag(0x0040, 0x0245), "TM", ""),
    Fixed("PerformedProcedureStepEndDate", tag(0x0040, 0x0250), "DA", ""),
    Fixed("PerformedProcedureStepEndTime", tag(0x0040, 0x0251), "TM", ""),
    Fixed("PerformedProcedureStepID", tag(0x0040, 0x0253), "SH", ""),
    Fixed("PerformedProcedureStepDescription", tag(0x0040, 0x0254), "LO", ""),
    Fixed("ScheduledProcedureStepDescription", tag(0x0040, 0x0007), "LO", ""),
    Fixed("ScheduledProcedureStepID", tag(0x0040, 0x0009), "SH", ""),
    Fixed("RequestedProcedureID", tag(0x0040, 0x1001), "SH", ""),
    Fixed("DeviceSerialNumber", tag(0x0018, 0x1000), "LO", ""),
    Fixed("PlateID", tag(0x0018, 0x1004), "LO", ""),
    Fixed("DetectorDescription", tag(0x0018, 0x7006), "LT", ""),
    Fixed("DetectorID", tag(0x0018, 0x700A), "SH", ""),
]

# Element names that are not their keyword's words (the standard's data dictionary).
ELEMENT_NAMES = {
    "PatientName": "Patient's Name",
    "PatientBirthDate": "Patient's Birth Date",
    "PatientSex": "Patient's Sex",
    "PatientAge": "Patient's Age",
    "PatientSize": "Patient's Size",
    "PatientWeight": "Patient's Weight",
    "PatientAddress": "Patient's Address",
    "ReferringPhysicianName": "Referring Physician's Name",
    "PerformingPhysicianName": "Performing Physician's Name",
    "OperatorsName": "Operators' Name",
}
