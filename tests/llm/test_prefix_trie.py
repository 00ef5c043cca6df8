import collections
import hashlib
import random
import zlib

import pytest

from incognita.llm import prefix_trie as P


def brute(rows):
    """Every node by its whole sequence, subtrees by looking at all nodes."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    paths = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(said.get(c - c % 20, [])[:h] + said[c][h:])
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    own = {s: (len(m) - 1) * (len(s[-1][1].encode().split()) if s else 0) for s, m in members.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for s in members:
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += own[s]
    return collections.Counter(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(s)))).encode()).hexdigest()) for s, m in members.items())


def corpus(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 2)))))
    return rows


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn int, role string, text string, a int, depth int").repartition(5)
    got = P.prefix_trie(df, **options).select(*COLS).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("height", [2, 16])
def test_equals_brute_force(spark, height):
    check(spark, corpus(height, 70, 9, ["a", "b"]), height=height)


def test_deep_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(P, "SPREAD", 7)
    monkeypatch.setattr(P, "CHAIN", 3)
    monkeypatch.setattr(P, "PIECE", 9)
    rows = corpus(5, 40, 4, ["a"]) + [(100 + c, t, "user", "x y" if t < 60 - c else f"z{c}") for c in (0, 1, 2) for t in range(75)]
    rows += [(200 + c, 0, None, None) for c in range(80)] + [(300, None, "user", "first"), (300, 0, "user", "second"), (None, 1, "user", "nobody")]
    rows += [(301, 5, "user", "same")] * 3 + [(302, 1, "user", "word " * 200_000)]
    check(spark, rows, height=3)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert P.prefix_trie(none).count() == 0


def test_conversation_without_turns_left(spark):
    c = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [(c, 0, "user", "gone")])


def test_hot_parents_are_found(spark, monkeypatch):
    rows = [(20 * c, 0, "user", f"t{c}") for c in range(60)] + [(20 * c, 1, "bot", "same") for c in range(60)]
    want = brute(rows)
    nodes = spark.createDataFrame([(0, 0, 0, 0, 60, [])] + [(i + 1, 0, 1, i, 1, [(0, 0)]) for i in range(20_000)],
                                  "a bigint, b bigint, depth int, conv_id bigint, n_convs bigint, above array<struct<a:bigint,b:bigint>>")
    totals = spark.createDataFrame([(0, 0, 20_000)], "a bigint, b bigint, kids bigint")
    got = P._with_parents(nodes, totals, 20_001)
    assert got.count() == 20_001 and got.where("depth = 1 and parent_conv_id = 0").count() == 20_000
    check(spark, rows)
    assert sum(want.values()) > 60


def test_no_plan_holds_that_of_another_level(spark, monkeypatch):
    sizes, stored = [], P.stored

    def size(df):
        return str(df._jdf.queryExecution().optimizedPlan().toString()).count("\n")

    def seen(df):
        sizes.append(size(df))
        return stored(df)

    def largest(depth):
        rows = [(c, t, "user", "x" if t < 2 else f"x{c}") for c in (0, 20) for t in range(depth)]
        sizes.clear()
        out = P.prefix_trie(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"), height=3)
        assert collections.Counter(map(tuple, out.select(*COLS).collect())) == brute(rows)
        return max(*sizes, size(out))

    monkeypatch.setattr(P, "stored", seen)
    two_levels, four_levels = largest(4), largest(30)
    assert four_levels <= two_levels  # a level more is a step more, not a larger plan
    assert four_levels < 100
