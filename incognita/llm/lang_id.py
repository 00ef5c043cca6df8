"""Language identification by words first, then progressively shorter character n-grams.

Fitting counts, per language, the words of labelled texts and their character
n-grams (words padded with one space on each side) of orders ``ORDERS``.
Prediction scores each word by its log10 relative frequency in each language if
any language knows the word; else by the mean over its n-grams of the longest
order of which one is known; a language that lacks the item gets the penalty.
The document's score for a language is the mean over its words, the prediction
the best language, and ``score`` its share after 10 ** mean is normalised.

Scale: fitting reads at most about ``FIT_ROWS`` labelled rows per language (a
hash decides, so the choice is the same on every run), counts them in Spark and
keeps the most frequent items, so that the model has at most ``MODEL_CELLS``
numbers whatever the corpus; the model is the only thing sent to executors.
Prediction is one narrow pass over the whole texts.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and
for all if nothing was learned; words of scripts that were never learned decide
nothing (``n_known`` tells how many words did), and a text of such words only gets
the first language in order at an even share; ties go to the language first in
order; null labels and null ids are not learned from; texts are read in
stretches; result columns get names that the documents do not have.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from incognita.llm.common import Hasher, col, fresh, raw, stored

ORDERS = (6, 5, 4, 3, 2, 1)
#: Labelled rows per language that the model is fitted on (the expected number).
FIT_ROWS = 4000
#: Most items of one order that one language keeps.
KEEP = 20_000
#: Most numbers in the model: items times languages.
MODEL_CELLS = 4 << 20
PENALTY = -7.0
#: Characters that are worked on at once.
STRETCH = 1 << 18


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 2 letter, 1 mark (may be inside a word), 0 other."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            kinds[c] = 2
        elif c >= 0x300 and unicodedata.category(s)[0] == "M":
            kinds[c] = 1
    return kinds


class Words:
    """The words of several texts, and hashes of any of their substrings."""

    def __init__(self, texts: list[str]):
        joined = " " + " ".join(texts) + " "
        points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) != len(joined):  # a few characters become longer in lower case
            texts = [t.lower() for t in texts]
            points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _kinds()[points]
        inside = kinds > 0
        points = np.where(inside, points, 32)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.stop = edge[0::2], edge[1::2]
        letters = np.concatenate([[0], np.cumsum(kinds == 2)])
        real = letters[self.stop] > letters[self.begin]
        self.begin, self.stop = self.begin[real], self.stop[real]
        self.hash = Hasher(points)
        limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(limits[1:], self.begin - 1, "right")

    def hashes(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.hash(begin, stop).view(np.int64)

    def grams(self, words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, hash) of each n-gram of the padded words; single characters are those of the bare words."""
        pad = int(order > 1)
        n = np.maximum(0, self.stop[words] - self.begin[words] + 2 * pad + 1 - order)
        at = np.repeat(np.arange(len(words)), n)
        first = self.begin[words][at] - pad + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.hashes(first, first + order)


def stretches(values: list[bytes | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of about STRETCH characters together; a longer text comes in parts, cut at spaces."""
    rows, texts, size = [], [], 0
    for i, value in enumerate(values):
        text = (value or b"").decode("utf-8", "replace")
        at = 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):
                end = text.find(" ", end, end + STRETCH)
                end = at + 2 * STRETCH if end < 0 else end
            rows.append(i)
            texts.append(text[at:end])
            size += len(texts[-1])
            at = end
            if size >= STRETCH:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


class Model:
    """Languages in order; for the words (order 0) and each n-gram order the sorted hashes and their log10 frequencies."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def look_up(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that are known, their rows of log frequencies)."""
        keys, logs = self.tables.get(order, (np.zeros(0, np.int64), None))
        if len(keys) == 0 or len(hashes) == 0:
            return np.zeros(0, np.int64), np.zeros((0, len(self.langs)))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = np.flatnonzero(keys[at] == hashes)
        return known, logs[at[known]]

    def word_scores(self, words: Words, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores by language, whether known) of distinct words."""
        scores, known = np.full((len(which), len(self.langs)), PENALTY), np.zeros(len(which), bool)
        at, logs = self.look_up(0, hashes)
        scores[at], known[at] = logs, True
        for order in ORDERS:
            left = np.flatnonzero(~known)
            if len(left) == 0:
                break
            place, grams = words.grams(which[left], order)
            at, logs = self.look_up(order, grams)
            n = np.bincount(place[at], minlength=len(left))
            some = np.flatnonzero(n)
            for j in range(len(self.langs)):
                scores[left[some], j] = np.bincount(place[at], logs[:, j], len(left))[some] / n[some]
            known[left[some]] = True
        return scores, known

    def predict(self, values: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, number of words, number of known words) of each text."""
        total, n_words, n_known = np.zeros((len(values), len(self.langs))), np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for rows, texts in stretches(values):
            words = Words(texts)
            if len(words.begin) == 0:
                continue
            hashes, first, back = np.unique(words.hashes(words.begin, words.stop), return_index=True, return_inverse=True)
            scores, known = self.word_scores(words, first, hashes)
            doc = np.array(rows)[words.text]
            n_words += np.bincount(doc, minlength=len(values))
            n_known += np.bincount(doc, known[back], len(values)).astype(np.int64)
            for j in range(len(self.langs)):
                total[:, j] += np.bincount(doc, scores[back, j], len(values))
        if not self.langs:
            return ["und"] * len(values), np.zeros(len(values)), n_words, n_known
        mean = total / np.maximum(1, n_words)[:, None]
        share = 10.0 ** (mean - mean.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        langs = ["und" if n == 0 else self.langs[b] for n, b in zip(n_words.tolist(), best.tolist(), strict=True)]
        return langs, np.where(n_words > 0, share.max(1), 0.0), n_words, n_known


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column | None = None, fit_rows: int = FIT_ROWS, keep: int = KEEP, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the rows of ``docs`` that ``learn`` allows and that have a label, an id and a text."""
    rows = docs.where(col(key).isNotNull() & col(lang).isNotNull() & col(text).isNotNull())
    rows = rows if learn is None else rows.where(learn)
    counts = {str(r[0]): r[1] for r in rows.groupBy(col(lang).cast("string")).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for name in langs for x in (name, float(min(1.0, fit_rows / counts[name])))])
    number = F.create_map(*[F.lit(x) for i, name in enumerate(langs) for x in (name, i)])
    name = col(lang).cast("string")
    point = (F.shiftrightunsigned(F.xxhash64(col(key).cast("string"), F.lit("fit")), 11) / F.lit(float(1 << 53)))
    sample = rows.where(point < share[name]).select(number[name].alias("lang"), raw(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def merged():
            data = np.concatenate(kept)
            order = np.lexsort((data["h"], data["n"], data["lang"]))
            data = data[order]
            first = np.flatnonzero(np.concatenate([[True], (data[1:][["lang", "n", "h"]] != data[:-1][["lang", "n", "h"]])]))
            out = data[first].copy()
            out["c"] = np.add.reduceat(data["c"], first)
            return out

        kind = np.dtype([("lang", np.int32), ("n", np.int32), ("h", np.int64), ("c", np.int64)])

        def add(lang: int, order: int, hashes: np.ndarray, weight: np.ndarray) -> None:
            h, back = np.unique(hashes, return_inverse=True)
            rows = np.empty(len(h), kind)
            rows["lang"], rows["n"], rows["h"], rows["c"] = lang, order, h, np.bincount(back, weight, len(h)).astype(np.int64)
            kept.append(rows)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[c].copy()) for c in ("lang", "n", "h", "c")], names=["lang", "n", "h", "c"])

        for batch in batches:
            of, values = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lang in np.unique(of).tolist():
                for _, texts in stretches([values[i] for i in np.flatnonzero(of == lang).tolist()]):
                    words = Words(texts)
                    if len(words.begin) == 0:
                        continue
                    h, first, times = np.unique(words.hashes(words.begin, words.stop), return_index=True, return_counts=True)
                    add(lang, 0, h, times)
                    for order in ORDERS:
                        at, grams = words.grams(first, order)
                        if len(at):
                            add(lang, order, grams, times[at])
            if sum(map(len, kept)) > 2_000_000:
                kept[:] = [merged()]
                if len(kept[0]) > 1_000_000:
                    yield batch_of(kept.pop())
        if kept:
            yield batch_of(merged())

    items = stored(sample.mapInArrow(count, "lang int, n int, h bigint, c bigint").groupBy("lang", "n", "h").agg(F.sum("c").alias("c")))
    totals = {(r[0], r[1]): r[2] for r in items.groupBy("lang", "n").agg(F.sum("c")).collect()}
    keep = max(1, min(keep, MODEL_CELLS // (len(langs) ** 2 * (len(ORDERS) + 1))))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "h"))
    top = items.withColumn("rank", rank).where(F.col("rank") <= keep).select("lang", "n", "h", "c").toPandas()
    tables = {}
    for order, rows in top.groupby("n"):
        hashes, back = np.unique(rows["h"].to_numpy(), return_inverse=True)
        logs = np.full((len(hashes), len(langs)), PENALTY)
        of = rows["lang"].to_numpy()
        logs[back, of] = np.log10(rows["c"].to_numpy() / np.array([totals[x, order] for x in of.tolist()]))
        tables[int(order)] = (hashes, logs)
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned): lang, score, n_words, n_known."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang string, score double, n_words bigint, n_known bigint")
    def predict(texts: pa.Array) -> pa.Array:
        langs, score, n, known = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(n), pa.array(known)], names=["lang", "score", "n_words", "n_known"])

    (out,) = fresh(docs, "language")
    return docs.withColumn(out, predict.asNondeterministic()(raw(text))), out


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Digest per document: doc_id, held_out, lang_pred, score, n_words, n_known; learned from the other three folds."""
    model = fit(docs, ~held_out(), fit_rows)
    found, c = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col(c)["lang"].alias("lang_pred"), F.col(c)["score"].alias("score"),
                        F.col(c)["n_words"].alias("n_words"), F.col(c)["n_known"].alias("n_known"))


def drop_unknown(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents with a known language, unchanged: those without a letter or without any known word or n-gram go."""
    found, c = identify(docs, fit(docs, None, fit_rows))
    return found.where((F.col(c)["lang"] != "und") & (F.col(c)["n_known"] > 0)).select(*[col(x) for x in docs.columns])
