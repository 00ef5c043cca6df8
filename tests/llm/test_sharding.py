import collections
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from incognita.llm import sharding as S


def check(rows, docs, shards=8):
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)


def test_hot_key_and_awkward_rows(spark, small_docs):
    rng = random.Random(1)
    docs = [(7, "hot" * rng.randint(0, 2)) for _ in range(400)] + [(i, "é" * rng.randint(0, 5)) for i in range(803)] + [(None, None), (None, "x"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    check(S.sharded(df).collect(), docs)
    check(S.sharded(small_docs.withColumnsRenamed({"lang": "shard", "source": "slot"})).collect(), [(r.doc_id, r.text) for r in small_docs.collect()])
    assert S.sharded(small_docs.limit(0)).count() == 0


def brute(cells, nodes, caps):
    """Row by row, clockwise to the first shard with room."""
    load, out = [0] * len(caps), collections.Counter()
    for cell in sorted(cells):
        i = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        while load[nodes[i][1]] >= caps[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        load[nodes[i][1]] += 1
        out[cell, nodes[i][1]] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, S.CELLS - 1), max_size=150), st.integers(1, 6), st.sampled_from([None, 0.1, 0.5]))
def test_walk_equals_row_by_row(cells, shards, epsilon):
    nodes, caps = S.ring(shards, 5), S.capacities(len(cells), shards, epsilon)
    got = collections.Counter()
    for cell, shares in S.walk(dict(collections.Counter(cells)), nodes, caps).items():
        for s, n in shares:
            got[cell, s] += n
    assert got == brute(cells, nodes, caps)


def test_limited_movement(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "cast(id as string) text")
    eight, nine = (S.assign(df, n, 0.1).select("doc_id", "shard", "home_shard") for n in (8, 9))
    a, b = eight.toPandas().set_index("doc_id"), nine.toPandas().set_index("doc_id")
    moved_home = (a.home_shard != b.home_shard.reindex(a.index))
    assert (b.home_shard.reindex(a.index)[moved_home] == 8).all()
    assert (a.shard != b.shard.reindex(a.index)).mean() < 0.25
    assert (a.shard != a.home_shard).mean() < 0.1 and a.shard.value_counts().max() <= 2750


def test_the_scan_keeps_its_partitions_and_small_rows_are_merged(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_PARTITIONS", 3)
    seen = []
    real = S.stored

    def noted(df):
        out = real(df)
        seen.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(S, "stored", noted)
    df = spark.range(0, 3000, 1, 20).selectExpr("id doc_id", "cast(id % 50 as string) text")
    rows = S.assign(df, 8).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert seen[0] == 20 and seen[1] <= 3
    check(rows, [(r.doc_id, r.text) for r in df.collect()])
