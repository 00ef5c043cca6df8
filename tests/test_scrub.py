"""Scrub rules on hand-built headers with nesting up to depth 2."""

import pytest
from pyspark.sql import functions as F

from helpers import T, el, frame, header
from incognita import model
from incognita.operators import scrub as S

PRIV_SQ = T(0x0011, 0x1001)
REQ = model.REQUEST_ATTRIBUTES_SEQUENCE
CODE_SQ = T(0x0032, 0x1064)
CONTENT = T(0x0040, 0xA730)
CURVE = T(0x5000, 0x3000)


def rich_file():
    return [
        el([model.STUDY_DATE], "StudyDate", "DA", "20240101"),
        el([T(0x0008, 0x002A)], "AcquisitionDateTime", "DT", "20240101120000"),
        el([model.PATIENT_NAME], "PatientName", "PN", "DOE^J"),
        el([model.PATIENT_ID], "PatientID", "LO", "PID1"),
        el([T(0x0011, 0x0010)], "", "LO", "private creator"),
        el([PRIV_SQ], "", "SQ", ""),
        el([PRIV_SQ, 0, model.PATIENT_NAME], "PatientName", "PN", "IN^PRIVATE"),
        el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", "1.2.3"),
        el([REQ], "RequestAttributesSequence", "SQ", ""),
        el([REQ, 0, T(0x0032, 0x1064)], "RequestedProcedureCodeSequence", "SQ", ""),
        el([REQ, 0, CODE_SQ, 0, T(0x0008, 0x0100)], "CodeValue", "SH", "C1"),
        el([REQ, 0, T(0x0040, 0x1001)], "RequestedProcedureID", "SH", "RP1"),
        el([CONTENT], "ContentSequence", "SQ", ""),
        el([CONTENT, 0, CONTENT], "ContentSequence", "SQ", ""),
        el([CONTENT, 0, CONTENT, 0, model.STUDY_DATE], "StudyDate", "DA", "20200101"),
        el([CONTENT, 0, CONTENT, 0, model.PATIENT_NAME], "PatientName", "PN", "DEEP^NAME"),
        el([CONTENT, 0, CONTENT, 0, CURVE], "CurveData", "OW", "c"),
        el([CONTENT, 1, model.STUDY_TIME], "StudyTime", "TM", "101010"),
        el([T(0x5000, 0x0005)], "CurveDimensions", "US", "2"),
        el([T(0x5010, 0x3000)], "CurveData", "OW", "c2"),
        el([T(0x5100, 0x0010)], "", "LO", "near miss"),
    ]


@pytest.fixture
def hdr(spark):
    rows = [header("r0/a/f1.dcm", sorted(rich_file(), key=lambda e: e.pos))]
    return frame(spark, rows)


def elements_of(df, col="elements"):
    return [r.asDict() for r in df.select(F.inline(col)).collect()]


def test_drop_private_removes_nested_public_children(hdr):
    out = elements_of(hdr.select(S.drop_private("elements").alias("elements")))
    assert all((t >> 16) % 2 == 0 for e in out for t in e["path_tags"])
    assert "IN^PRIVATE" not in [e["value"] for e in out]


def test_drop_curves_at_every_depth_keeps_near_miss(hdr):
    out = elements_of(hdr.select(S.drop_curves("elements").alias("elements")))
    groups = {t >> 16 for e in out for t in e["path_tags"]}
    assert not any((g & 0xFF00) == 0x5000 for g in groups)
    assert "near miss" in [e["value"] for e in out]


def test_drop_sequence_removes_all_descendants(hdr):
    out = elements_of(hdr.select(S.drop_tags("elements", [REQ]).alias("elements")))
    assert not any(REQ in e["path_tags"] for e in out)
    assert "C1" not in [e["value"] for e in out]


def test_vr_replacement_at_depth_two_and_dt_untouched(hdr):
    out = elements_of(hdr.select(S.replace_by_vr("elements").alias("elements")))
    for e in out:
        if e["vr"] == "PN":
            assert e["value"] == "anonymous"
        if e["vr"] in ("DA", "TM"):
            assert e["value"] == ""
    assert "20240101120000" in [e["value"] for e in out]


def test_full_scrub(hdr):
    out_df = hdr.select(S.scrub("elements", F.lit("AB1234"), F.lit("IRB9")).alias("elements"))
    out = elements_of(out_df)
    top = {e["pos"][0]: e for e in out if len(e["pos"]) == 1}
    for f in model.FIXED_ASSIGNMENTS:
        assert f.tag in top, f.keyword
        expected = {"<study_id>": "AB1234", "<patient_name>": "IRB9"}.get(f.value, f.value)
        assert top[f.tag]["value"] == expected
        assert top[f.tag]["vr"] == f.vr
    values = [e["value"] for e in out]
    for secret in ("DOE^J", "PID1", "IN^PRIVATE", "DEEP^NAME", "20200101", "101010", "C1", "RP1"):
        assert secret not in values
    assert "near miss" in values and "20240101120000" in values
    assert [e["pos"] for e in out] == sorted(e["pos"] for e in out)  # preorder kept
    assert not any(REQ in e["path_tags"] for e in out)


def test_scrub_is_idempotent(hdr):
    once = hdr.select(S.scrub("elements", F.lit("AB1234"), F.lit("IRB9")).alias("elements"))
    twice = once.select(S.scrub("elements", F.lit("AB1234"), F.lit("IRB9")).alias("elements"))
    assert elements_of(once) == elements_of(twice)


def test_reference_literal_rules_keep_request_sequence(hdr):
    out = elements_of(hdr.select(S.scrub("elements", rules=S.REFERENCE_LITERAL_RULES).alias("elements")))
    assert any(REQ in e["path_tags"] for e in out)


def test_rules_from_table(spark, hdr):
    rows = spark.createDataFrame(
        [("drop_private", None, None, None, None, None),
         ("set_vr", "PN", "X", None, None, None),
         ("upsert", "LO", "St Nowhere", model.tag(0x0008, 0x0080), None, "InstitutionName")],
        "action string, vr string, value string, tag bigint, mask bigint, keyword string").collect()
    rules = S.Rules.from_rows(rows)
    out = elements_of(hdr.select(S.scrub("elements", rules=rules).alias("elements")))
    assert {e["value"] for e in out if e["vr"] == "PN"} == {"X"}
    assert any(e["value"] == "St Nowhere" for e in out)
    assert any(e["keyword"] == "CurveData" for e in out)  # no curve rule in this table


def test_anon_name_and_output_path(spark):
    df = spark.createDataFrame([("C:\\data\\ptZERO", ""), ("/mnt/x/patient-zero/", None), ("/mnt/y", "IRB7")],
                               "root string, irb string")
    got = [r[0] for r in df.select(S.anon_name(F.col("irb"), F.col("root"))).collect()]
    assert got == ["ptZERO", "patient-zero", "IRB7"]
    p = spark.createDataFrame([("/d/root", "/d/root/a/b/f.dcm")], "root string, path string")
    assert p.select(S.output_path()).first()[0] == "/d/root-anon/a/b/f.dcm"


@pytest.mark.parametrize("rules", [S.DEFAULT_RULES, S.REFERENCE_LITERAL_RULES,
                                   S.Rules(drop_private=False, drop_tags=(model.tag(0x0010, 0x0010), REQ))])
def test_fused_scrub_equals_stepwise(hdr, rules):
    a = elements_of(hdr.select(S.scrub("elements", F.lit("ID1"), F.lit("N"), rules).alias("elements")))
    b = elements_of(hdr.select(S.scrub_stepwise("elements", F.lit("ID1"), F.lit("N"), rules).alias("elements")))
    assert a == b


def test_path_rules_match_nested_elements_and_equal_the_steps(spark):
    rules = S.Rules(paths=(((528656, 524320), "19000101"), ((528656, 524320), "later rules of a path do not count"),
                               ((528656, 2097165), None), ((999, 5), None), ((777,), "set"), ((524320,), "it's \\ kept")),
                        fixed=(), drop_tags=())
    rows = [([528656], [528656], "SQ", ""), ([528656, 0, 524320], [528656, 524320], "DA", "20240101"), ([528656, 1, 524320], [528656, 524320], "DA", "20240102"),
            ([528656, 0, 2097165], [528656, 2097165], "SQ", ""), ([528656, 0, 2097165, 0, 8], [528656, 2097165, 8], "LO", "below"),
            ([524320], [524320], "DA", "20240103"), ([888, 0, 524320], [888, 524320], "DA", "20240104"), ([778], [778], "LO", "stays")]
    df = spark.createDataFrame([([(p, t, "", vr, v) for p, t, vr, v in rows],), ([],), (None,)],
                               "elements array<struct<pos:array<bigint>,path_tags:array<bigint>,keyword:string,vr:string,value:string>>")
    got = df.select(S.scrub("elements", rules=rules).alias("a"), S.scrub_stepwise("elements", rules=rules).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[1].a == [] and got[2].a is None
    assert [(list(e.pos), e.value) for e in got[0].a] == [
        ([528656], ""), ([528656, 0, 524320], "19000101"), ([528656, 1, 524320], "19000101"), ([524320], "it's \\ kept"),
        ([888, 0, 524320], ""), ([778], "stays")]


def test_thousands_of_path_rules_are_looked_up_by_hash(spark):
    many = S.Rules(paths=tuple(((131_072 + 2 * i, 7), None if i % 2 else str(i)) for i in range(2000)))
    df = spark.range(3).select(F.expr("array(named_struct('pos', array(131080L, 0L, 7L), 'path_tags', array(131080L, 7L), 'keyword', '', 'vr', 'LO', 'value', 'x'))").alias("elements"))
    out = df.select(S.scrub("elements", rules=many).alias("e"))
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()
    assert all([x.value for x in r.e if x.pos[0] == 131080] == ["4"] for r in out.collect())
