"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of ``window`` consecutive words of the
benchmark items (an item with fewer words is one window). Windows of one length
m share a searcher with the three tables of the method:

* the block shift table: for each block of B = 2 words, how far the search may
  jump because no window can end before that; unknown blocks jump m - B + 1;
* the suffix buckets: windows by their last block, looked at where the shift is 0;
* the prefix table within a bucket, after which a direct comparison confirms.

Scale: the windows come from a Spark job, are counted, and are split by hash
into blocks of at most ``block_bytes``; each block is one broadcast and one pass
over the documents. With one block documents are not shuffled at all. With more,
what each further pass finds (rows of hit texts only) is merged by text digest.

Defined cases: null or wordless texts have no words and are clean; a null item
text gives no window; a null item_id counts as the id ''; repeated documents get
equal results, repeated items count once; texts of any length are read in
stretches with an overlap of one window less a word; an empty benchmark leaves
everything clean. Result columns never clash with those of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from incognita.llm.common import col, fresh, raw, word_runs

#: Bytes of windows (with 64 for each row's overhead) that one broadcast block may hold.
BLOCK_BYTES = 16 << 20
#: A text is split into words in stretches of about so many bytes.
STRETCH = 1 << 20

#: Lower-case ASCII letters, digits and all bytes of non-ASCII characters are word bytes; the rest separates.
_WORD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256)
)

_FOUND = "n_words bigint, spans array<struct<begin:bigint,stop:bigint>>, items array<string>"
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


class WuManber:
    """Finds test strings that all have ``m`` words (space-joined, lower case)."""

    def __init__(self, m: int, strings: dict[bytes, list[str]]):
        self.m, self.strings, self.b = m, strings, min(2, m)
        self.far = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for string in strings:
            words = string.split(b" ")
            blocks = self._blocks(words)
            for end, block in enumerate(blocks, self.b - 1):
                self.shift[block] = min(self.shift.get(block, self.far), m - 1 - end)
            self.buckets.setdefault(blocks[-1], {}).setdefault(blocks[0], set()).add(string)

    def _blocks(self, words: list[bytes]) -> list:
        return words if self.b == 1 else list(zip(words, words[1:], strict=False))

    def find(self, words: list[bytes], first: int = 0) -> Iterator[tuple[int, bytes]]:
        """(position of the last word, test string) of each occurrence that ends at ``first`` or later."""
        m, far, single = self.m, self.far, self.b == 1
        shift, i, n = self.shift.get, max(self.m - 1, first), len(words)
        while i < n:
            block = words[i] if single else (words[i - 1], words[i])
            jump = shift(block, far)
            if jump:
                i += jump
                continue
            begin = i - m + 1
            candidates = self.buckets[block].get(words[begin] if single else (words[begin], words[begin + 1]))
            if candidates:
                string = b" ".join(words[begin : i + 1])
                if string in candidates:
                    yield i, string
            i += 1


def search(text: bytes | None, searchers: list[WuManber], stretch: int = STRETCH) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(number of words, merged spans of hit words, sorted items with an occurring window)."""
    n, carry, ends, found = 0, [], [], set()
    overlap = max((s.m for s in searchers), default=1) - 1
    for words in word_runs(text or b"", _WORD, stretch):
        at, words = n - len(carry), carry + words if carry else words
        for s in searchers:
            for i, string in s.find(words, len(carry)):
                ends.append((at + i - s.m + 1, at + i + 1))
                found.add((s.m, string))
        n = at + len(words)
        carry = words[len(words) - overlap :] if overlap and len(words) > overlap else words if overlap else []
    spans: list[tuple[int, int]] = []
    for a, b in sorted(ends):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    by_m = {s.m: s for s in searchers}
    return n, spans, sorted({item for m, string in found for item in by_m[m].strings[string]})


def windows(benchmark: DataFrame, window: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (item, m, words) rows: every window of every item."""

    def cut(batches):
        for batch in batches:
            rows = set()
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for part in word_runs(value or b"", _WORD, STRETCH) for w in part]
                m = min(window, len(words))
                if m:
                    rows |= {(name, m, b" ".join(words[i : i + m])) for i in range(len(words) - m + 1)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                names=["item", "m", "words"])

    return (benchmark.select(F.coalesce(col(item).cast("string"), F.lit("")).alias("item"), raw(text).alias("text"))
            .mapInArrow(cut, "item string, m int, words binary").distinct())


def _searchers(rows: list[tuple[str, int, bytes]]) -> list[WuManber]:
    by: dict[int, dict[bytes, list[str]]] = {}
    for item, m, words in rows:
        by.setdefault(m, {}).setdefault(words, []).append(item)
    return [WuManber(m, strings) for m, strings in sorted(by.items())]


def _finder(spark, rows: list[tuple[str, int, bytes]]):
    sent = spark.sparkContext.broadcast(rows)

    @arrow_udf(_FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searchers = _searchers(sent.value)
        for batch in texts:
            out = []
            for value in batch:
                n, spans, items = search(value.as_py(), searchers)
                out.append({"n_words": n, "spans": [{"begin": a, "stop": b} for a, b in spans], "items": items})
            yield pa.array(out, _FOUND_ARROW)

    return find.asNondeterministic()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
               block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): n_words, spans of hit words, items that occur."""
    spark = docs.sparkSession
    made = windows(benchmark, window)
    size = made.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks))
    (out,) = fresh(docs, "leaks")

    def rows(k: int) -> list[tuple]:
        part = made if n_blocks == 1 else made.where(block == k)
        return [tuple(r) for r in part.collect()]  # at most about block_bytes

    marked = docs.withColumn(out, _finder(spark, rows(0))(raw(text)))
    if n_blocks == 1:
        return marked, out
    digest = F.sha2(raw(text), 256)
    more = None
    for k in range(1, n_blocks):
        hit = (docs.where(col(text).isNotNull()).select(digest.alias("k"), _finder(spark, rows(k))(raw(text)).alias("f"))
               .where(F.size("f.spans") > 0)
               .dropDuplicates(["k"]))  # copies have equal finds; combined before the shuffle
        more = hit if more is None else more.unionByName(hit)
    more = more.groupBy("k").agg(F.flatten(F.collect_list("f.spans")).alias("spans"),  # one row a block at most
                                 F.flatten(F.collect_list("f.items")).alias("items"))

    @arrow_udf("array<struct<begin:bigint,stop:bigint>>")
    def merged(a: pa.Array) -> pa.Array:
        out = []
        for spans in a.to_pylist():
            kept: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["begin"], s["stop"])):
                if kept and s["begin"] <= kept[-1]["stop"]:
                    kept[-1]["stop"] = max(kept[-1]["stop"], s["stop"])
                else:
                    kept.append(dict(s))
            out.append(kept)
        return pa.array(out, _FOUND_ARROW.field("spans").type)

    key, spans, items = fresh(marked, "digest_key", "more_spans", "more_items")
    more = more.select(F.col("k").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    joined = marked.withColumn(key, digest).join(more, key, "left")
    both = F.struct(
        F.col(out)["n_words"].alias("n_words"),
        F.when(F.col(spans).isNull(), F.col(out)["spans"]).otherwise(merged(F.concat(F.col(out)["spans"], F.coalesce(spans, F.array())))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat(F.col(out)["items"], F.coalesce(F.col(items), F.array())))).alias("items"))
    return joined.withColumn(out, both).select(*[col(c) for c in docs.columns], out), out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found, c = find_leaks(docs.select("doc_id", "text"), benchmark, window)
    n_hit = F.aggregate(F.col(c)["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["begin"])
    return (found.select("doc_id", F.col(c)["n_words"].alias("n_words"), n_hit.alias("n_hit"),
                         F.size(F.col(c)["items"]).cast("bigint").alias("n_items"),
                         F.sha2(F.concat_ws(",", F.col(c)["items"]).cast("binary"), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, unchanged."""
    found, c = find_leaks(docs, benchmark, window)
    return found.where(F.size(F.col(c)["spans"]) == 0).select(*[col(x) for x in docs.columns])
