"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Patterns give the base spans: credentials assigned to a telling name, access key
ids, and long lower-case hex strings. The method adds what has no telling name:
runs of 20 or more key characters that look random.

1. Encoding. A run's alphabet is the smallest of ``ENCODINGS`` that holds all its
   characters, by the classes (digits, A-F, ...) it has. Runs of digits alone are numbers, not keys.
2. Battery. Under "random in that alphabet": chi-squared of the symbol counts
   (exact mean and variance, so that few symbols suffice), runs above and below the
   middle of the alphabet, and the serial correlation of neighbours. The three
   p-values are combined by Fisher's rule; below ``REFUSED`` the run has a structure
   (a word, a path, a counter, a repeated letter) and is no key.
3. False discoveries. Under "ordinary text" (symbols drawn by the frequencies
   that the corpus has outside spans and candidate runs, class changes between
   neighbours at its rate) a run of n symbols gets a p-value from its symbol counts and
   its class changes, both by its own length, so short runs need to be more
   striking. The Benjamini-Hochberg rule over all runs of the corpus (refused ones
   count with p = 1) sets the cutoff at a false-discovery rate of ``RATE``.

Scale: the texts are read once; base spans, candidate runs (five numbers each)
and per-task symbol counts are stored in ``spark.checkpoint.dir``. Nothing is
shuffled but the counts of at most ``BINS`` p-value bins a task; the driver sees
one row of 66 counts a task's sum and those bins. No key or source groups rows.

Defined cases: a null text is empty; empty texts have no spans; texts of any
length are scanned whole; repeated rows are scanned each, and count each in the
rates; a corpus without candidates has the base spans alone; spans are in code
points, the end exclusive; a run inside a base span adds nothing; only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm.common import col, stored

KINDS = ("assign", "access", "hex", "random")

# Fixed by the contract; letters of the first in either case (ASCII only).
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

#: Runs of key characters with padding signs at their end; shorter ones are not tested.
LEAST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order in which they are tried.
ENCODINGS: dict[str, str] = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "base32": UPPER + DIGITS[2:8],
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
_NAMES = list(ENCODINGS)
_RANK = np.full((len(_NAMES), 256), -1, np.int64)
for _e, _alphabet in enumerate(ENCODINGS.values()):
    _RANK[_e, np.frombuffer(_alphabet.encode(), np.uint8)] = np.arange(len(_alphabet))
_SIZES = np.array([len(a) for a in ENCODINGS.values()], np.float64)

#: Class of a byte: lower, upper, digit, sign; 0 for others.
_CLASS = np.zeros(256, np.int8)
for _c, _members in enumerate((LOWER, UPPER, DIGITS, "+/_-"), 1):
    _CLASS[np.frombuffer(_members.encode(), np.uint8)] = _c

#: Battery p-value below which a run is not random.
REFUSED = 1e-3
#: Share of wrong finds that is accepted among the added spans.
RATE = 0.01
#: Bins of minus log10 p, ``STEP`` each; the last holds all beyond.
BINS, STEP = 6000, 0.05


# ---- spans by pattern ----------------------------------------------------------

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, by start and kind; kinds as in ``KINDS``."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def encoding(symbols: np.ndarray) -> int:
    """Number of the smallest alphabet that holds all symbols; -1 for digits alone or letters of one case without a digit."""
    classes = np.bincount(_CLASS[symbols], minlength=5)
    if classes[1:].astype(bool).sum() < 2 and not classes[4]:
        return -1
    for e in range(len(_NAMES)):
        if (_RANK[e, symbols] >= 0).all():
            return e
    return -1


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher(ps: list[float]) -> float:
    """Combined p-value of two or three independent ones."""
    y = -sum(math.log(max(p, 1e-300)) for p in ps)
    return min(1.0, math.exp(-y) * sum(y ** i / math.factorial(i) for i in range(len(ps))))


def battery(ranks: np.ndarray, k: float) -> tuple[float, float, float]:
    """p-values of symbol counts, runs and serial correlation under "random in an alphabet of k"."""
    n = len(ranks)
    counts = np.bincount(ranks).astype(np.float64)
    chi = k / n * float((counts ** 2).sum()) - n
    p_chi = upper_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
    high = ranks >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 == 0 or n0 == 0:
        p_runs = 2.0 ** (1 - n)
    else:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = min(1.0, 2 * upper_tail(abs(runs - mean) / spread))
    x = ranks - ranks.mean()
    power = float((x * x).sum())
    # lag-1 correlation of n independent values: mean -1/n, variance 1/n nearly
    r = float((x[1:] * x[:-1]).sum()) / power if power else 1.0
    p_serial = min(1.0, 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n)))
    return p_chi, p_runs, p_serial


Run = tuple[int, int, int, int, float, int]  # start, end, encoding, symbols, sum of squared counts, class changes


def candidates(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[Run], int]:
    """Runs outside the given spans that the battery does not refuse, and the number of those it does."""
    kept, refused = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if any(s <= start and end <= e for s, _, e in spans):
            continue
        symbols = np.frombuffer(m.group().rstrip("=").encode(), np.uint8)
        e = encoding(symbols)
        if e >= 0:
            ranks = _RANK[e, symbols]
            if fisher(list(battery(ranks, float(_SIZES[e])))) >= REFUSED:
                classes = _CLASS[symbols]
                kept.append((start, end, e, len(symbols), float((np.bincount(ranks).astype(np.float64) ** 2).sum()),
                             int((classes[1:] != classes[:-1]).sum())))
                continue
        refused += 1
    return kept, refused


# ---- what ordinary text does ------------------------------------------------------

def ordinary_part(text: str, spans: list[tuple[int, int, int]], runs: list[Run]) -> bytes:
    """The text without its base spans and candidate runs, which are no ordinary text."""
    out, at = [], 0
    for start, end in sorted([(s, e) for s, _, e in spans] + [r[:2] for r in runs]):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return " ".join(out).encode()


def symbol_counts(data: bytes) -> np.ndarray:
    """Counts of the 256 byte values, then pairs of neighbouring key characters and those of unequal class."""
    a = np.frombuffer(data, np.uint8)
    out = np.zeros(258, np.int64)
    if len(a):
        out[:256] = np.bincount(a, minlength=256)
        c = _CLASS[a]
        both = (c[1:] > 0) & (c[:-1] > 0)
        out[256] = both.sum()
        out[257] = (both & (c[1:] != c[:-1])).sum()
    return out


class Ordinary:
    """p-values of a run under "ordinary text", from the corpus's symbol counts."""

    def __init__(self, counts: np.ndarray):
        self.power = []
        for alphabet in ENCODINGS.values():
            f = counts[np.frombuffer(alphabet.encode(), np.uint8)] + 0.5
            f = f / f.sum()
            self.power.append((float((f ** 2).sum()), float((f ** 3).sum())))
        self.change = float(min(max((counts[257] + 1) / (counts[256] + 2), 1e-6), 0.5))

    def __call__(self, e: int, n: int, squares: float, changes: int) -> float:
        q2, q3 = self.power[e]
        mean = n + n * (n - 1) * q2
        var = 2 * n * (n - 1) * (q2 - q2 ** 2) + 4 * n * (n - 1) * (n - 2) * max(q3 - q2 ** 2, 0.0)
        p_counts = upper_tail((mean - squares) / math.sqrt(max(var, 1e-9)))
        t, a = n - 1, changes / (n - 1)
        if a <= self.change:
            p_changes = 1.0
        else:  # Chernoff's bound of the binomial tail
            gap = a * math.log(a / self.change) + ((1 - a) * math.log((1 - a) / (1 - self.change)) if a < 1 else 0.0)
            p_changes = math.exp(-min(t * gap, 690.0))
        return fisher([p_counts, p_changes])


def p_bin(p: float) -> int:
    return min(int(-math.log10(max(p, 1e-300)) / STEP), BINS - 1)


def cutoff_bin(bins: dict[int, int], tested: int, rate: float) -> int:
    """Smallest bin of minus log10 p whose p-values, at their largest, keep the Benjamini-Hochberg bound; BINS for none."""
    best, seen = BINS, 0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if 10 ** (-b * STEP) * tested <= rate * seen:
            best = b
    return best


# ---- the operator ------------------------------------------------------------------

_SPAN = "struct<start:bigint,kind:int,stop:bigint>"
_SCAN = (f"base array<{_SPAN}>, runs array<struct<start:bigint,stop:bigint,enc:int,n:bigint,squares:double,changes:bigint>>, refused bigint, "
         "counts array<bigint>")
_SCAN_ARROW = [pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])),
               pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("enc", pa.int32()), ("n", pa.int64()), ("squares", pa.float64()),
                                   ("changes", pa.int64())])),
               pa.int64(), pa.list_(pa.int64())]


def _scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Base spans and candidate runs of each document; one more row a task holds its symbol counts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(258, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            base, runs, refused = [], [], []
            for value in batch.column(1).to_pylist():
                value = value or ""
                spans = base_spans(value)
                found, no = candidates(value, spans)
                total += symbol_counts(ordinary_part(value, spans, found))
                base.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
                runs.append([dict(zip(("start", "stop", "enc", "n", "squares", "changes"), r, strict=True)) for r in found])
                refused.append(no)
            cols = [pa.array(x, t) for x, t in zip((base, runs, refused, [None] * len(base)), _SCAN_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "runs", "refused", "counts"])
        if kind is not None:
            cols = [pa.array([x], t) for x, t in zip((None, None, None, total.tolist()), _SCAN_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), *cols], names=["doc_id", "base", "runs", "refused", "counts"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text).cast("string").alias("t"))
    return rows.mapInArrow(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_SCAN}")


def find(docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found): the spans of each document as structs (start, kind, stop), by start and kind."""
    scanned = stored(_scan(docs, id_col, text))
    summed = scanned.where(F.col("counts").isNotNull()).select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(258, np.int64)
    for r in summed:  # 258 rows
        counts[r["at"]] = r["n"]
    rows = scanned.where(F.col("counts").isNull()).drop("counts")
    sent = docs.sparkSession.sparkContext.broadcast(Ordinary(counts))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, int] = {}
        for batch in batches:
            for runs, refused in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out[-1] = out.get(-1, 0) + refused
                for r in runs:
                    b = p_bin(sent.value(r["enc"], r["n"], r["squares"], r["changes"]))
                    out[b] = out.get(b, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["bin", "n"])

    seen = {r["bin"]: r["n"] for r in rows.select("runs", "refused").mapInArrow(bins, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    tested = sum(seen.values())
    seen.pop(-1, None)
    cut = cutoff_bin(seen, tested, rate)  # from BINS + 1 bins at most

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                more = [{"start": r["start"], "kind": 3, "stop": r["stop"]} for r in runs
                        if p_bin(sent.value(r["enc"], r["n"], r["squares"], r["changes"])) >= cut]
                found.append(sorted(base + more, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SCAN_ARROW[0])], names=["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc_id", "base", "runs").mapInArrow(add, f"doc_id {kind}, found array<{_SPAN}>")


def _listed(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(kind: int):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")


def secrets(docs: DataFrame) -> DataFrame:
    """Digest per document: counts of the patterns' spans, their hash, and all spans."""
    found = find(docs)
    of = [_count(k) for k in range(len(KINDS))]
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", *of[:3], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), of[3])
