"""Conversation prefix trie: subtree totals by a depth-band rollup.

A conversation's turns, ordered by turn number, are a path from the textless
root; conversations that begin with the same turns share the path's nodes. A
node is named by 128 bits: the exclusive or of one hash a turn (of depth, role
and text), so a parent's name needs no chain of hashes and parts of a path are
hashed apart.

Depths are cut into bands of ``HEIGHT``. A node carries the names of its
ancestors within its band, at most ``HEIGHT``, and gives its own values (leaf,
saved tokens) to each of them: one sum by name. The nodes on a band's floor are
the roots of the next band. What the roots now hold are the totals of their
bands; they form a trie of their own, ``HEIGHT`` times flatter, which is rolled
up in the same way, bands of bands. The completed totals of the band roots are
then given to their ancestors inside the band above. So a trie of depth D takes
log D / log HEIGHT rounds and a node at most ``HEIGHT`` rows a round.

Scale: the texts are read once, for a hash and a word count. Turns are numbered by
a range-partitioned sort, and all work on a conversation goes by blocks of its
turns, so one that holds a third of all rows is split; its block hashes are
chained in two steps of 1,024 blocks. Sums combine before they shuffle. The ids
that end at a node are joined in pieces of 4 KB by range-partitioned tasks, and
hashed as a stream. Children of the nodes with the most children (at most 1,000
nodes) find their parent's row by broadcast, the others by a join on its name.
What is used twice is stored in ``spark.checkpoint.dir``.

Defined cases: a null role or text is empty; a null turn number comes first;
turns with the same number are ordered by their hash, and repeated rows are
turns of their own; rows without a conversation id belong to no conversation and
are left out; a conversation that loses all its turns in the rebuilding ends at
the root; an empty table gives no nodes; texts of any length are hashed whole;
only four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incognita.functions.ranking import consecutive_index
from incognita.llm.common import col, runs, stored

#: Levels of a band.
HEIGHT = 16
#: Blocks of a conversation that are chained in one step.
CHAIN = 1024
#: Turns of a conversation that meet its row in one place.
SPREAD = 4096
#: Characters of joined ids in one row.
PIECE = 4096
#: Nodes whose children look them up by broadcast.
HOT = 1000


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def turns_of(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, t1, t2, words): the rows of all conversations, hashed."""
    said, by = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (text, role))
    return convs.where(col(conv_id).isNotNull()).select(
        col(conv_id).cast("bigint").alias("c"), col(turn).cast("bigint").alias("turn"), F.xxhash64(F.lit(1), by, said).alias("t1"),
        F.xxhash64(F.lit(2), by, said).alias("t2"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, len) and their rebuilt turns (c, d, t1, t2, words, len).

    Conversation c begins with the first h turns of c - c % every, h = crc32(c) % heads, and goes on with its own after its first h.
    """
    numbered = consecutive_index(turns, ["c", "turn", "t1", "t2"], name="idx").withColumn("block", F.floor(F.col("idx") / SPREAD))
    own = numbered.groupBy("c").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    own = own.withColumn("base", F.col("c") - F.pmod("c", F.lit(every))).withColumn("h", (F.crc32(F.col("c").cast("string")) % heads).cast("int"))
    base_n = F.max(F.when(F.col("c") == F.col("base"), F.col("n"))).over(Window.partitionBy("base"))  # ``every`` rows a base at most
    based = own.withColumn("base_n", base_n)
    m = F.least(F.col("h"), F.coalesce("base_n", _zero())).cast("int")
    convs = stored(based.withColumn("m", m).withColumn("len", (F.col("m") + F.greatest(F.col("n") - F.col("h"), _zero())).cast("int")))
    spread = convs.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / SPREAD), F.floor((F.col("first") + F.col("n") - 1) / SPREAD))))
    at = numbered.join(spread.select("c", "block", "first", "h", "m", "len"), ["c", "block"]).withColumn("i", (F.col("idx") - F.col("first") + 1).cast("int"))
    kept = at.where("i > h").select("c", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "t1", "t2", "words", "len")
    head = at.where((F.col("i") < heads) & (F.pmod("c", F.lit(every)) == 0)).select(F.col("c").alias("base"), F.col("i").alias("d"), "t1", "t2", "words")
    taken = convs.where("m > 0").select("c", "base", "m", "len").join(head, "base").where("d <= m").select("c", "d", "t1", "t2", "words", "len")
    return convs.select("c", "len"), kept.unionByName(taken)


# ---- paths ----------------------------------------------------------------------

def _xor(x: Column, y: Column) -> Column:
    return F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))


def _hash(item: Column) -> Column:
    return F.struct(F.xxhash64(item["d"], item["t1"]).alias("a"), F.xxhash64(item["d"], item["t2"]).alias("b"))


def path_blocks(turns: DataFrame, height: int) -> DataFrame:
    """(c, k, len, items, ids): a conversation's turns (d, words) at depths k * height + 1 to (k + 1) * height, with the names of these nodes after that above them."""
    items = F.sort_array(F.collect_list(F.struct("d", "t1", "t2", "words")))
    blocks = turns.groupBy("c", F.floor((F.col("d") - 1) / height).alias("k")).agg(items.alias("items"), F.max("len").alias("len"))
    whole = F.aggregate("items", F.struct(_zero().alias("a"), _zero().alias("b")), lambda acc, it: _xor(acc, _hash(it)))
    blocks = stored(blocks.withColumn("x", whole))
    short, long = blocks.where(F.col("len") <= height), blocks.where(F.col("len") > height)

    steps = long.select("c", "k", F.floor(F.col("k") / CHAIN).alias("s"), "x.a", "x.b")
    before = Window.partitionBy("c", "s").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inner = steps.select("c", "k", "s", *[F.coalesce(F.bit_xor(x).over(before), _zero()).alias(x) for x in ("a", "b")])
    sums = steps.groupBy("c", "s").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    outer = sums.select("c", "s", *[F.coalesce(F.bit_xor(x).over(before), _zero()).alias("o" + x) for x in ("a", "b")])
    above = inner.join(outer, ["c", "s"]).select("c", "k", F.struct(F.col("a").bitwiseXOR(F.col("oa")).alias("a"), F.col("b").bitwiseXOR(F.col("ob")).alias("b")).alias("p"))
    named = short.withColumn("p", F.struct(_zero().alias("a"), _zero().alias("b"))).unionByName(long.join(above, ["c", "k"]))
    ids = F.aggregate("items", F.array("p"), lambda acc, it: F.concat(acc, F.array(_xor(F.element_at(acc, -1), _hash(it)))))
    said = F.transform("items", lambda it: F.struct(it["d"].alias("d"), it["words"].alias("words")))
    return stored(named.select("c", "k", "len", said.alias("items"), ids.alias("ids")))  # read by all that follows, at every level


def trie(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b, depth, conv_id, n_convs, n_ends, leaves, saved, above): the nodes; ``above`` are the ancestors within the band, top first."""
    rows = blocks.select("c", "len", "ids", F.posexplode("items").alias("j", "item"))
    rows = rows.select("c", "len", F.col("item.d").alias("depth"), "item.words", F.get("ids", F.col("j") + 1).alias("id"), F.slice("ids", F.lit(1), F.col("j") + 1).alias("above"))
    nodes = rows.groupBy("id.a", "id.b").agg(
        F.min("depth").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"),
        F.min("words").alias("words"), F.first("above").alias("above"))
    root = convs.agg(F.lit(0).alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("len") == 0).alias("n_ends")).where("n_convs > 0")
    root = root.select(_zero().alias("a"), _zero().alias("b"), "*", F.lit(0).alias("words"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("above"))
    return nodes.unionByName(root).select(
        "a", "b", "depth", "conv_id", "n_convs", "n_ends", F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).cast("bigint").alias("saved"), "above")


# ---- rollup ---------------------------------------------------------------------

def _given(to: Column, leaves: Column, saved: Column, kids: Column) -> Column:
    return F.struct(to["a"].alias("a"), to["b"].alias("b"), leaves.cast("bigint").alias("leaves"), saved.cast("bigint").alias("saved"), kids.cast("bigint").alias("kids"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in ("leaves", "saved", "kids")])


def rollup(nodes: DataFrame, floors: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(a, b, leaves, saved, kids): totals of each node's subtree, itself included, and its number of children.

    ``nodes`` has (a, b, depth, leaves, saved, above), one row a node; ``floors``
    the conversations' paths over the nodes on the floors of the bands:
    (c, k, a, b), k = depth / height. What a level hands to another is stored, so
    that no level's plan holds that of another.
    """
    on_floor = F.col("depth") % height == 0
    me, n = F.struct("a", "b"), F.size("above")
    up = F.transform("above", lambda x, i: _given(x, F.col("leaves"), F.col("saved"), (i == n - 1).cast("int")))
    alone = F.array(_given(me, F.col("leaves"), F.col("saved"), F.lit(0)))
    parent = F.transform(F.slice("above", -1, 1), lambda x: _given(x, F.lit(0), F.lit(0), F.lit(1)))
    given = F.when(F.col("depth") == 0, alone).when(on_floor, F.concat(alone, parent)).otherwise(F.concat(alone, up))
    sums = stored(_summed(nodes.select(F.explode(given).alias("g")).select("g.*")))
    if (nodes.agg(F.max("depth")).first()[0] or 0) < height:
        return sums
    # the band roots hold the totals of their bands: a trie of their own
    floors = stored(floors)
    level = ancestors(floors, height).join(sums.select("a", "b", "leaves", "saved"), ["a", "b"])
    level = stored(level)
    higher = floors.where(F.col("k") % height == 0).withColumn("k", (F.col("k") / height).cast("bigint"))
    done = rollup(level, higher, height).select("a", "b", "leaves", "saved")
    below = nodes.where(on_floor & (F.col("depth") > 0)).select("a", "b", "above").join(done, ["a", "b"])
    lifted = F.transform(F.slice("above", F.lit(2), F.size("above")), lambda x: _given(x, F.col("leaves"), F.col("saved"), F.lit(0)))
    inside = below.select(F.explode(lifted).alias("g")).select("g.*")
    floor = nodes.where(on_floor).select("a", "b")
    # a floor's own total replaces its band's; its children are counted already
    replaced = sums.join(floor, ["a", "b"], "left_semi").select("a", "b", _zero().alias("leaves"), _zero().alias("saved"), "kids")
    return stored(_summed(sums.join(floor, ["a", "b"], "left_anti").unionByName(replaced).unionByName(done.withColumn("kids", _zero())).unionByName(inside)))


def ancestors(path: DataFrame, height: int) -> DataFrame:
    """(a, b, depth, above) of the nodes on paths (c, k, a, b) from k = 0 on."""
    band = F.floor((F.col("k") - 1) / height)
    heads = path.where(F.col("k") % height == 0).select("c", F.floor(F.col("k") / height).alias("band"), "k", "a", "b")
    rows = path.where("k > 0").select("c", band.alias("band"), "k", "a", "b").unionByName(heads)
    grouped = rows.groupBy("c", "band").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("ids"))
    ids = F.transform("ids", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    each = grouped.select(F.col("ids").alias("at"), ids.alias("ids")).select("ids", F.posexplode("at").alias("j", "x")).where("j > 0")
    each = each.select("x.a", "x.b", F.col("x.k").alias("depth"), F.slice("ids", F.lit(1), F.col("j")).alias("above"))
    nodes = each.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.first("above").alias("above"))
    root = path.where("k = 0").select("a", "b").distinct().select("a", "b", _zero().alias("depth"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("above"))
    return nodes.unionByName(root)


# ---- conversations that end at a node -------------------------------------------

def ends_hash(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, c): the decimal ids, ascending and comma-joined."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size, out = None, None, [], 0, []
        for k, part, begins in runs(batches, ["a", "b"]):
            if begins and parts:
                out.append((*key, first, ",".join(parts)))
                parts, size = [], 0
            key = tuple(int(x) for x in k)
            for c in part.column(2).to_pylist():
                if not parts:
                    first = c
                parts.append(str(c))
                size += len(parts[-1]) + 1
                if size >= PIECE:
                    out.append((*key, first, ",".join(parts)))
                    parts, size = [], 0
            if len(out) >= 1000:
                yield _pieces(out)
                out = []
        if parts:
            out.append((*key, first, ",".join(parts)))
        yield _pieces(out)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, None, []
        for k, part, begins in runs(batches, ["a", "b"]):
            if begins:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h, comma = tuple(int(x) for x in k), hashlib.sha256(), b""
            for text in part.column(3).to_pylist():
                h.update(comma + text.encode())
                comma = b","
            if len(out) >= 10_000:
                yield _hashes(out)
                out = []
        if key is not None:
            out.append((*key, h.hexdigest()))
        yield _hashes(out)

    pieces = ends.select("a", "b", "c").repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(join, "a bigint, b bigint, first bigint, ids string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], texts: int) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == texts else pa.int64()) for i, c in enumerate(cols)], names=names)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["a", "b", "first", "ids"], 3)


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["a", "b", "ends_sha256"], 2)


# ---- the operator ---------------------------------------------------------------

def _with_parents(nodes: DataFrame, totals: DataFrame, n_nodes: int) -> DataFrame:
    """Add parent_conv_id; the few parents with very many children are broadcast."""
    many = max(10_000, -(-n_nodes // HOT))
    named = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    hot = totals.where(F.col("kids") >= many).select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(named, ["pa", "pb"])  # n_nodes / many rows at most
    kids = nodes.select("a", "b", "depth", "conv_id", "n_convs", F.try_element_at("above", F.lit(-1)).alias("p"))
    kids = kids.select("a", "b", "depth", "conv_id", "n_convs", F.col("p.a").alias("pa"), F.col("p.b").alias("pb"))
    tried = kids.join(F.broadcast(hot), ["pa", "pb"], "left")
    known = tried.where("depth = 0 or parent_conv_id is not null")
    rest = tried.where("depth > 0 and parent_conv_id is null").drop("parent_conv_id").join(named, ["pa", "pb"])
    return known.unionByName(rest).drop("pa", "pb")


def prefix_trie(convs: DataFrame, height: int = HEIGHT, every: int = 20, heads: int = 4) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (all but the last bigint)."""
    each, turns = rebuilt(turns_of(convs), every, heads)
    blocks = path_blocks(turns, height)
    nodes = stored(trie(each, blocks))
    n_nodes = nodes.count()
    floors = blocks.select("c", F.col("k").alias("k"), F.col("ids")[0].alias("id")).unionByName(
        blocks.where(F.size("items") == height).select("c", (F.col("k") + 1).alias("k"), F.element_at("ids", -1).alias("id"))).distinct().select("c", "k", "id.a", "id.b")
    totals = rollup(nodes, floors, height)
    last = F.element_at("items", -1)["d"] == F.col("len")
    ends = blocks.where(last).select(F.element_at("ids", -1).alias("id"), "c").select("id.a", "id.b", "c").unionByName(
        each.where("len = 0").select(_zero().alias("a"), _zero().alias("b"), "c"))
    full = _with_parents(nodes, totals, n_nodes).join(totals, ["a", "b"]).join(ends_hash(ends), ["a", "b"], "left")
    return full.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
                       F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
