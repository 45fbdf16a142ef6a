"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word backs off to its character
n-grams, marked at word ends: the longest length of which any is known gives the word's score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, join_hot, map_columns, staged

#: Combining marks, which many scripts write vowels with, belong to the word.
MARKS = "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{MARKS}])*")
LETTERS = re.compile(r"[^\W\d_]+")
MARK = frozenset(MARKS)
#: The model is fitted on about this many documents of each language (chosen by hash), which bounds its size.
TRAIN_DOCS = 2500
#: Words and n-grams seen fewer times in the sample are not kept.
LEAST_WORD, LEAST_GRAM = 2, 3
LONGEST = 5
#: Letters of the longest unseen word whose scores are cached.
LONGEST_WORD = 40
CACHED = 300_000


def words_of(text: str) -> list[str]:
    """Lower-case words. The plain pattern is enough, and faster, where there are no marks."""
    text = text.lower()
    return (WORD if not text.isascii() and not MARK.isdisjoint(text) else LETTERS).findall(text)


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language, a batch at a time."""
    for b in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[lang].update(words_of(text))
        rows = [(lang, w, n) for lang, own in seen.items() for w, n in own.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "item", "n"])


def _to_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    seen[lang, g] += n
        yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "item", "n"])


class Model:
    """Log frequencies of words, and of n-grams of each length, by language."""

    def __init__(self, words: list[tuple[str, str, int]], gram_rows: list[tuple[str, str, int]]):
        self.langs = sorted({r[0] for r in words} | {r[0] for r in gram_rows})
        self.words, self.word_logs = self._table(words)
        tables = [self._table([r for r in gram_rows if len(r[1]) == n]) for n in range(1, LONGEST + 1)]
        self.grams = [t[0] for t in tables]
        self.gram_logs = [t[1] for t in tables]
        self.cache: dict[str, np.ndarray] = {}

    def _table(self, rows: list[tuple[str, str, int]]) -> tuple[dict[str, int], np.ndarray]:
        index: dict[str, int] = {}
        for _, item, _ in rows:
            index.setdefault(item, len(index))
        counts = np.full((len(index), len(self.langs)), 0.1)
        lang = {x: i for i, x in enumerate(self.langs)}
        for x, item, n in rows:
            counts[index[item], lang[x]] += n
        return index, np.log(counts / counts.sum(0)).astype(np.float32) if len(index) else counts.astype(np.float32)

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            own = [i for g in grams(word, n) if (i := self.grams[n - 1].get(g)) is not None]
            if own:
                return self.gram_logs[n - 1][own].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        known, index, cache = [], self.words, self.cache
        total = np.zeros(len(self.langs))
        for w in words:
            i = index.get(w)
            if i is not None:
                known.append(i)
            else:
                found = cache.get(w)
                if found is None:
                    if len(cache) >= CACHED:
                        cache.clear()
                    found = self.unseen(w)
                    if len(w) <= LONGEST_WORD:
                        cache[w] = found
                total += found
        if known:
            total += self.word_logs[known].sum(0, dtype=np.float64)
        odds = np.exp(np.maximum(total - total.max(), -700))
        return self.langs[int(total.argmax())], float(odds.max() / odds.sum())


def learn(docs: DataFrame) -> Model:
    """A model from rows that have a text and a lang and are not held out: a hash picks about TRAIN_DOCS of each language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rates = staged(rows.groupBy("lang").count().withColumn("rate", F.lit(TRAIN_DOCS) / F.col("count")), "langid-rates")
    total = rates.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    picked = join_hot(rows, rates, ["lang"], "count", total).filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    words = picked.select("lang", "text").mapInArrow(_count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")).persist()
    found = [words.filter(F.col("n") >= LEAST_WORD), words.mapInArrow(_to_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_GRAM)]
    model = Model(*[sorted(map(tuple, x.toPandas().itertuples(index=False))) for x in found])
    words.unpersist()
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the whole text is scored.

    `und` with score 0 for texts that are null or have no letter, and for all if nothing could be
    learned. Repeated rows give a row each; extra columns are ignored. The model, whose size
    TRAIN_DOCS and the number of languages bound, is broadcast; scoring is a map without shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
        return pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_columns(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
