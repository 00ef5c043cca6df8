"""Randomised headers: the fused scrub equals the rule-by-rule scrub, and its invariants hold."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import el, frame, header
from incognita import model
from incognita.operators import scrub as S

GROUPS = [0x0008, 0x0010, 0x0011, 0x0020, 0x0029, 0x0040, 0x5000, 0x50FF, 0x5100]
VRS = ["PN", "DA", "TM", "DT", "LO", "SH", "SQ", "UI"]

tags = st.builds(lambda g, e: model.tag(g, e), st.sampled_from(GROUPS), st.integers(0, 0x30))
fixed_tags = st.sampled_from([f.tag for f in model.FIXED_ASSIGNMENTS] + [model.REQUEST_ATTRIBUTES_SEQUENCE])
any_tag = st.one_of(tags, fixed_tags)


@st.composite
def files(draw):
    """A preorder element list with sequences up to depth 2."""
    out = []
    for t in sorted(set(draw(st.lists(any_tag, min_size=1, max_size=6)))):
        out.append(el([t], "", draw(st.sampled_from(VRS)), draw(st.text("ab^1", max_size=4))))
        if draw(st.booleans()):
            for item in range(draw(st.integers(1, 2))):
                for t2 in sorted(set(draw(st.lists(any_tag, max_size=3)))):
                    out.append(el([t, item, t2], "", draw(st.sampled_from(VRS)), "v"))
                    if draw(st.booleans()):
                        out.append(el([t, item, t2, 0, draw(any_tag)], "", "PN", "deep"))
    return sorted(out, key=lambda e: e.pos)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(files(), min_size=1, max_size=5))
def test_scrub_properties(spark, batch):
    df = frame(spark, [header(f"r/f{i}.dcm", els) for i, els in enumerate(batch)])
    fused = df.select("path", S.scrub("elements", F.lit("SID"), F.lit("NAME")).alias("e"))
    step = df.select("path", S.scrub_stepwise("elements", F.lit("SID"), F.lit("NAME")).alias("e"))
    a = {r.path: r.e for r in fused.collect()}
    b = {r.path: r.e for r in step.collect()}
    assert a == b
    fixed = {f.tag for f in model.FIXED_ASSIGNMENTS}
    for els in a.values():
        assert [e.pos for e in els] == sorted(e.pos for e in els)
        for e in els:
            assert not any((t >> 16) % 2 for t in e.path_tags)
            assert not any(((t >> 16) & 0xFF00) == 0x5000 for t in e.path_tags)
            assert model.REQUEST_ATTRIBUTES_SEQUENCE not in e.path_tags
            if e.vr in ("DA", "TM") and e.path_tags[0] not in fixed:
                assert e.value == ""
            if e.vr == "PN" and len(e.pos) > 1:
                assert e.value == "anonymous"
        assert {e.pos[0] for e in els if len(e.pos) == 1} >= fixed


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="dluc", min_size=1, max_size=3), st.text(alphabet="AB-", max_size=2))
def test_mask_decode_is_a_bijection(spark, mask, prefix):
    import re

    from incognita.functions import masks

    cap = masks.capacity(mask)
    df = spark.createDataFrame([(mask,)], "mask string")
    assert int(df.select(masks.capacity_col(F.col("mask"))).first()[0]) == cap
    ids = [r.s for r in spark.range(cap).select(masks.decode_code(F.col("id"), mask, prefix).alias("s")).collect()]
    assert len(set(ids)) == cap
    classes = {"d": "[0-9]", "l": "[a-z]", "u": "[A-Z]", "c": "[a-zA-Z]"}
    pattern = re.escape(prefix) + "".join(classes[ch] for ch in mask)
    assert all(re.fullmatch(pattern, i) for i in ids)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 3000), st.integers(1, 9), st.integers(0, 5))
def test_consecutive_index_random(spark, n, parts, start):
    from pyspark.sql import Window

    from incognita.functions.ranking import consecutive_index

    df = spark.range(n).repartition(parts).select(((F.col("id") * 7919) % 3001).alias("k"), "id")
    got = consecutive_index(df, ["k", "id"], name="idx", start=start, num_partitions=parts)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")) + start - 1)
    assert got.count() == n
    assert got.join(ref, ["k", "id"]).where(F.col("idx") != F.col("rn")).count() == 0


@st.composite
def corpora(draw):
    """Files with random roots/paths/UIDs, and a registry with some studies already known."""
    n_files = draw(st.integers(1, 25))
    uids = [f"u{draw(st.integers(0, 9))}" for _ in range(n_files)]
    files = [(f"r{ro}/d{draw(st.integers(0, 3))}/f{i}.dcm", ro, uid)
             for i, (uid, ro) in enumerate((u, draw(st.integers(0, 2))) for u in uids)]
    n_slots = draw(st.integers(1, 12))
    known = draw(st.lists(st.sampled_from([f"u{i}" for i in range(10)]), max_size=min(4, n_slots), unique=True))
    return files, n_slots, known


def brute_force(files, n_slots, known):
    """Plain-Python model: study -> ID (None when the pool is exhausted)."""
    slots = {2 + i: f"ID{i:02d}" for i in range(n_slots)}
    owner = {uid: slots[2 + i] for i, uid in enumerate(known)}
    first = {}
    for path, ro, uid in files:
        if uid not in first or (ro, path) < first[uid]:
            first[uid] = (ro, path)
    new = sorted((key, uid) for uid, key in first.items() if uid not in owner)
    nxt = 2 + len(known)
    for _, uid in new:
        owner[uid] = slots.get(nxt)
        nxt += 1
    return {path: owner[uid] for path, _, uid in files}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(corpora())
def test_assignment_matches_brute_force(spark, corpus):
    from incognita.plans import deidentify as deid
    from incognita.sources import fixtures as fx

    files, n_slots, known = corpus
    rows = [header(p, [el([model.STUDY_INSTANCE_UID], "StudyInstanceUID", "UI", u)], root=f"r{ro}", root_ord=ro)
            for p, ro, u in files]
    slot_rows = [(2 + i, f"ID{i:02d}", "P" if i < len(known) else None, known[i] if i < len(known) else None)
                 for i in range(n_slots)]
    slots = fx._as_slots(spark.createDataFrame(
        slot_rows, "row_no bigint, study_id string, patient_id string, study_uid string"))
    run = deid.plan(frame(spark, rows), slots, {"n_study_ids": n_slots, "irb_code": "I"})
    got = {r.path: r.study_id for r in run.files.select("path", "study_id").collect()}
    assert got == brute_force(files, n_slots, known)


def scrub_model(elements, study_id, name):
    """Plain-Python model of the default scrub rules."""
    fixed = {f.tag: f for f in model.FIXED_ASSIGNMENTS}

    def dropped(e):
        return any((t >> 16) % 2 == 1 or ((t >> 16) & 0xFF00) == 0x5000
                   or t == model.REQUEST_ATTRIBUTES_SEQUENCE for t in e.path_tags) or e.path_tags[0] in fixed

    out = []
    for e in elements:
        if dropped(e):
            continue
        value = {"PN": "anonymous", "DA": "", "TM": ""}.get(e.vr, e.value)
        out.append((list(e.pos), list(e.path_tags), e.keyword, e.vr, value))
    for f in model.FIXED_ASSIGNMENTS:
        value = {"<study_id>": study_id, "<patient_name>": name}.get(f.value, f.value)
        out.append(([f.tag], [f.tag], f.keyword, f.vr, value))
    return sorted(out, key=lambda x: x[0])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(files(), min_size=1, max_size=4))
def test_scrub_matches_python_model(spark, batch):
    df = frame(spark, [header(f"r/f{i}.dcm", els) for i, els in enumerate(batch)])
    got = {r.path: [(list(e.pos), list(e.path_tags), e.keyword, e.vr, e.value) for e in r.e]
           for r in df.select("path", S.scrub("elements", F.lit("SID"), F.lit("NAME")).alias("e")).collect()}
    for i, els in enumerate(batch):
        assert got[f"r/f{i}.dcm"] == scrub_model(els, "SID", "NAME")


@st.composite
def screened_files(draw):
    name = draw(st.sampled_from(["DICOMDIR", "dicomdir", "VERSION", "LOCKFILE", "a.dcm", "b"]))
    magic = draw(st.sampled_from(["DICM", "JUNK", None]))
    bad = draw(st.sampled_from([None, "truncated"]))
    els = []
    for kw in model.TAG_CHECKLIST:
        t = model.KEYWORD_TAGS[kw]
        where = draw(st.sampled_from(["absent", "top", "nested"]))
        val = draw(st.sampled_from(["", "x"]))
        if where == "top":
            els.append(el([t], kw, "LO", val))
        elif where == "nested":
            seq = model.tag(0x0008, 0x1110)
            els.append(el([seq, 0, t], kw, "LO", val))
    seq = model.tag(0x0008, 0x1110)
    if any(e.pos[0] == seq for e in els):
        els.append(el([seq], "ReferencedStudySequence", "SQ", ""))
    return name, magic, bad, sorted(els, key=lambda e: e.pos)


def screen_model(name, magic, bad, els):
    uid = next((e.value for e in els if e.path_tags[-1] == model.STUDY_INSTANCE_UID), None)
    if name in model.SKIP_LIST:
        outcome = "skiplist"
    elif magic != "DICM":
        outcome = "not_dicom"
    elif bad is not None:
        outcome = "unreadable"
    elif not uid:
        outcome = "no_uid"
    else:
        outcome = "ok"
    top = {e.path_tags[0] for e in els if len(e.path_tags) == 1}
    missing = [k for k in model.TAG_CHECKLIST if model.KEYWORD_TAGS[k] not in top]
    warn = " ".join(missing) if outcome in ("ok", "no_uid") and missing else None
    return outcome, warn


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(screened_files(), min_size=1, max_size=8))
def test_screening_matches_python_model(spark, batch):
    from incognita.operators import screen

    rows = [header(f"r/{i}/{n}", els, magic=m, parse_error=b) for i, (n, m, b, els) in enumerate(batch)]
    c = screen.classify(frame(spark, rows))
    outcomes = {r.path: r.outcome for r in c.select("path", "outcome").collect()}
    warns = {r.path: r.missing_tags for r in screen.tag_warnings(c).collect()}
    for i, (n, m, b, els) in enumerate(batch):
        outcome, warn = screen_model(n, m, b, els)
        assert outcomes[f"r/{i}/{n}"] == outcome
        assert warns.get(f"r/{i}/{n}") == warn


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.integers(-5, 5), min_size=1, max_size=12),
                          st.lists(st.integers(-5, 5), min_size=1, max_size=12)), min_size=1, max_size=6))
def test_pixel_stats_match_python_model(spark, pairs):
    from incognita.operators import pixels

    rows = [(i, a, b, 1, len(a), 1, len(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "pair_id long, a array<int>, b array<int>, a_rows int, a_cols int, "
                                     "b_rows int, b_cols int")
    got = {r.pair_id: r for r in pixels.pixel_stats(df).collect()}
    eq = {r.pair_id: r.pixels_equal for r in pixels.pixel_equal(df).collect()}
    for i, (a, b) in enumerate(pairs):
        n = max(len(a), len(b))
        pa, pb = a + [None] * (n - len(a)), b + [None] * (n - len(b))
        mism = sum(1 for x, y in zip(pa, pb) if x != y)
        r = got[i]
        assert (r.n_pixels, r.n_mismatch, r.min_a, r.max_a, r.min_b, r.max_b) == (n, mism, min(a), max(a), min(b), max(b))
        assert eq[i] == (a == b)


def pool_model(n, mask, prefix, suffix, secret):
    import hashlib

    from incognita.functions import masks

    alph = [model.MASK_ALPHABETS[ch] for ch in mask]
    cap = masks.capacity(mask)
    seen, order, draw = set(), [], 0
    while len(order) < n:
        code = int(hashlib.sha256(f"{secret}{draw}".encode()).hexdigest()[:15], 16) % cap
        if code not in seen:
            seen.add(code)
            order.append(code)
        draw += 1
    ids = []
    for code in order:
        chars = []
        for a in reversed(alph):
            chars.append(a[code % len(a)])
            code //= len(a)
        ids.append(prefix + "".join(reversed(chars)) + suffix)
    return ids, draw


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="dlu", min_size=1, max_size=3), st.integers(1, 60), st.text(alphabet="xy", max_size=3))
def test_pool_matches_python_model(spark, mask, n, secret):
    from incognita.functions import masks
    from incognita.operators import idpool

    n = min(n, masks.capacity(mask))
    req = idpool.PoolRequest(n=n, mask=mask, prefix="P-", suffix="!", secret=secret or "s")
    pool = idpool.generate(spark, req)
    got = [r.study_id for r in pool.orderBy("row_no").collect()]
    ids, draws = pool_model(n, mask, "P-", "!", secret or "s")
    assert got == ids
    assert idpool.pool_stats(pool, req).first().draws_used == draws
