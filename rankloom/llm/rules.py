"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

The trusted documents and the whole corpus each give a multinomial over byte
n-grams hashed to ``buckets`` buckets (smoothed by one count a bucket). A text's
score is the mean, over its n-grams, of the log ratio of the two probabilities;
texts that score ``threshold`` or more and pass the base rules are kept. The
decision is a fixed threshold on integers, so it's the same on every run and for
every order of rows, and nothing is sampled.

The counts cover all documents. What reaches the driver and goes back to the
executors is one number a bucket.

Defined cases: null text has no words, fails the base rules and is not kept; a
text shorter than an n-gram scores 0; without trusted documents every score is
0; rows that repeat a document get one row each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, column, sized, written

SYMBOLS = "#*$%&|<>"
#: Log ratios are kept as integers of this many parts of 1.
UNIT = 1_000_000
#: Bytes of text that are hashed in one go.
CHUNK = 1 << 21


def text_chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes, with the index of their first."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= most):
            held += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def byte_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of bytes (uint32) inside the texts in order, and how many each text has."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(flat) < 4:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    x = flat.astype(np.uint32)
    grams = x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]
    inside = np.ones(len(flat), dtype=bool)
    ends = np.cumsum(sizes)
    for k in range(1, 4):
        at = ends - k
        inside[at[at >= ends - sizes]] = False
    return grams[inside[: len(grams)]], np.maximum(sizes - 3, 0)


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values (integers)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def hashed(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * np.uint32(2654435769)) >> np.uint32(32 - bits)


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with ``trusted``: whether the doc_id is among those given."""
    ids = sized(written(trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("trusted", F.lit(True)), "trusted"))
    return docs.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def log_ratios(docs: DataFrame, trusted: DataFrame, bits: int) -> np.ndarray:
    """Integer log ratio of each bucket. docs: doc_id, text as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts, flags = as_bytes(batch), column(batch, "trusted").to_numpy(zero_copy_only=False)
            for i, part in text_chunks(texts):
                grams, counts = byte_grams(part)
                h = hashed(grams, bits)
                raw += np.bincount(h, minlength=1 << bits)
                good += np.bincount(h[np.repeat(flags[i : i + len(part)].astype(bool), counts)], minlength=1 << bits)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], good[used])], names=["bucket", "raw", "good"])

    rows = marked(docs, trusted).select("text", "trusted").mapInArrow(run, "bucket long, raw long, good long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()  # one row a bucket
    raw, good = np.ones(1 << bits), np.ones(1 << bits)
    at = table["bucket"].to_numpy()
    raw[at] += table["raw"].to_numpy()
    good[at] += table["good"].to_numpy()
    if not table["good"].to_numpy().sum():
        return np.zeros(1 << bits, np.int32)
    return np.round(UNIT * (np.log(good / good.sum()) - np.log(raw / raw.sum()))).astype(np.int32)


def repeated_words(words: list, window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    total, covered = 0, 0
    for k, g in enumerate(grams):
        if counts[g] > 1:
            total += k + window - max(k, covered)
            covered = k + window
    return total


def base_counts(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(raw.count, map(str.encode, SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = -0.3, bits: int = 16, least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log ratio), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted, bits))
    fixed = round(threshold * UNIT)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in batches:
            texts = as_bytes(batch)
            base = np.array([base_counts(t.decode(), t) for t in texts], dtype=np.int64).reshape(-1, 5)
            sums, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, part in text_chunks(texts):
                grams, counts = byte_grams(part)
                sums.append(per_text(ratios[hashed(grams, bits)], counts))
                n.append(counts)
            total, n = np.concatenate(sums), np.concatenate(n)
            failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeats * base[:, 0])
            kept = ~failed & (total >= fixed * n)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(total / np.maximum(n, 1) / UNIT), pa.array(kept)],
                names=["doc_id", *names, "base_failed", "score", "kept"],
            )

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, score double, kept boolean")
