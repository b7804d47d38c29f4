"""Language identification by words, with backoff to character n-grams.

Learned from a bounded, deterministic sample of labelled documents
(``per_language`` for each language, chosen by hash; the only bound there is):
log frequencies of all words of each language, and of its character n-grams of
``longest`` down to 1 characters with word edges, each length on its own. A word
that some language knows is scored by those frequencies; an unseen word is
walked from its start, each character by the longest n-gram ending there that is
known, shorter n-grams costing a fixed factor a step. A text's language is the
one with the largest sum over its words; the score is its share after scaling
the sums by the number of words, so it says how clear the case is and not how
long the text. Words are runs of letters, of Unicode's categories L.

Defined cases: null texts and texts without a letter give ``und`` and score 0;
ties go to the first language in order; with nothing to learn from, every text
is ``und``; very long texts are scored whole; further columns are ignored, and
``lang`` is read only of rows that the caller marks for training.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, sized, written

PENALTY = math.log(0.4)
#: Unseen words whose scores a worker keeps.
CACHE = 200_000


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Runs of letters: what ``\\w`` takes beside them (other numbers, marks) is left out, character by character."""
    others = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isdecimal() and unicodedata.category(x)[0] != "L"]
    ranges = []
    for c in others:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile(r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]+")


class LanguageModel:
    """Log frequencies of words and n-grams: a row of a table for each, one value a language."""

    def __init__(self, words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]], longest: int):
        self.languages, self.longest = sorted(grams), longest
        self.words, self.word_logs = self._logs(words, lambda x: 0)
        self.grams, self.gram_logs = self._logs(grams, len)
        self.floor = np.full(len(self.languages), -16.0)

    def _logs(self, counts: dict[str, dict[str, int]], kind: Callable[[str], int]) -> tuple[dict[str, int], np.ndarray]:
        """log((count + 0.5) / (total + 0.5 types + 1)), over items of one kind."""
        index: dict[str, int] = {}
        for g in self.languages:
            for x in counts.get(g, {}):
                index.setdefault(x, len(index))
        kinds = np.fromiter(map(kind, index), dtype=np.int64, count=len(index))
        types = np.bincount(kinds, minlength=1)
        out = np.empty((len(index), len(self.languages)))
        for k, g in enumerate(self.languages):
            table = counts.get(g, {})
            n = np.fromiter((table.get(x, 0) for x in index), dtype=np.float64, count=len(index))
            totals = np.bincount(kinds, weights=n, minlength=1)
            out[:, k] = np.log((n + 0.5) / (totals + 0.5 * types + 1)[kinds])
        return index, out

    def unseen(self, word: str) -> np.ndarray:
        """Backoff: the longest known n-gram that ends at each character."""
        text = f"<{word}>"
        total = np.zeros(len(self.languages))
        for end in range(2, len(text) + 1):
            for n in range(min(self.longest, end), 0, -1):
                if (row := self.grams.get(text[end - n : end])) is not None:
                    total += self.gram_logs[row] + (self.longest - n) * PENALTY
                    break
            else:
                total += self.floor
        return total / (len(text) - 1)


def grams_of(word: str, longest: int) -> list[str]:
    text = f"<{word}>"
    return [text[i : i + n] for n in range(1, longest + 1) for i in range(len(text) - n + 1)]


def train(docs: DataFrame, per_language: int = 3000, longest: int = 4) -> LanguageModel:
    """docs: doc_id, text, lang, the rows to learn from. Tables are counted on
    the executors; what reaches the driver is the vocabulary of ``per_language``
    documents a language."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    sample = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    # ids only are ranked; texts are read for the chosen ones
    chosen = sample.distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_language).select("doc_id", "lang")
    rows = docs.join(sized(written(chosen, "lang-sample")), ["doc_id", "lang"]).select("lang", F.col("text").cast("binary").alias("text"))

    word = word_pattern()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), as_bytes(batch)):
                seen.setdefault(lang, Counter()).update(word.findall(text.decode().lower()))
        for lang, table in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(table)), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], names=["lang", "word", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "lang-words")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(column(batch, x).to_pylist() for x in ("lang", "word", "n"))):
                table = seen.setdefault(lang, Counter())
                for g in grams_of(word, longest):
                    table[g] += n
        for lang, table in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(table)), pa.array(list(table)), pa.array(list(table.values()), pa.int64())], names=["lang", "word", "n"]
            )

    gram_counts = counted.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def tables(df: DataFrame) -> dict[str, dict[str, int]]:
        out: dict[str, dict[str, int]] = {}
        for batch in df.orderBy("lang", "word").toArrow().to_batches():
            for lang, x, n in zip(*(column(batch, c).to_pylist() for c in ("lang", "word", "n"))):
                out.setdefault(lang, {})[x] = n
        return out

    return LanguageModel(tables(counted), tables(gram_counts), longest)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score: a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index, table, word = m.words, m.word_logs, word_pattern()
        unseen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, scores = [], []
            for text in as_bytes(batch):
                words = word.findall(text.decode().lower()) if text else []
                if not words or not m.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                ids = np.fromiter(map(index.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
                total = table[ids[ids >= 0]].sum(axis=0)
                for w, n in Counter(words[k] for k in np.flatnonzero(ids < 0)).items():
                    if (row := unseen.get(w)) is None:
                        if len(unseen) >= CACHE:
                            unseen.clear()
                        row = unseen[w] = m.unseen(w)
                    total = total + n * row
                mean = total / len(words)
                best = int(mean.argmax())
                langs.append(m.languages[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, lang_pred string, score double")
