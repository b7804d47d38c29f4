"""Token counts from pre-tokens, without token ids of any document.

A text is cut at special strings of the vocabulary and then into pre-tokens by
the vocabulary's own pattern. Pass one counts, over all texts, in how many
blocks and documents each pre-token occurs; each distinct pre-token is encoded
once for its number of pieces. Pass two joins these counts to the pre-token
frequencies of each document: the most frequent pre-tokens (at most ``hot`` of
them, found from the histogram of counts) by a broadcast table of that bounded
size, all others by a shuffled join. Sums per document give the counts.

Defined cases: null text counts as empty; an empty text has 0 tokens; a text is
never cut by length; rows that repeat a document get one row each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, top_by_count, written

#: Pre-tokens kept by a task before it passes its counts on.
FLUSH = 300_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _cutter(path: str, pattern: str):
    """Pattern of pre-tokens, and that of the special strings (or None)."""
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    return regex.compile(pattern), split, frozenset(special)


def pretokens(text: str, path: str, pattern: str) -> Counter:
    """Frequencies of the pre-tokens and special strings of a text.

    A special string is its own piece; it can't be mistaken for a pre-token,
    which never holds letters and punctuation together.
    """
    cut, split, special = _cutter(path, pattern)
    if split is None or not any(x in text for x in special):
        return Counter(cut.findall(text))
    counts: Counter = Counter()
    for part in split.split(text):
        if part in special:
            counts[part] += 1
        else:
            counts.update(cut.findall(part))
    return counts


def distinct_pretokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """piece string, docs long: in how many documents each pre-token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "docs"])
            seen.clear()
            return out

        for batch in batches:
            for text in as_bytes(batch):
                seen.update(pretokens(text.decode(), path, pattern).keys())
                if len(seen) >= FLUSH:
                    yield flush()
        yield flush()

    cols = docs.select(F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(run, "piece string, docs long").groupBy("piece").agg(F.sum("docs").alias("docs"))


def piece_counts(distinct: DataFrame, path: str, batch_size: int = 4096) -> DataFrame:
    """piece, docs, n: the number of pieces of each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            pieces = column(batch, "piece").to_pylist()
            n: list[int] = []
            for i in range(0, len(pieces), batch_size):
                n += map(len, tok.encode_batch(pieces[i : i + batch_size], add_special_tokens=False))
            yield pa.RecordBatch.from_arrays([column(batch, "piece"), column(batch, "docs"), pa.array(n, pa.int64())], names=["piece", "docs", "n"])

    return distinct.select("piece", "docs").mapInArrow(run, "piece string, docs long, n long")


def token_counts(docs: DataFrame, path: str, pattern: str, hot: int = 1 << 19) -> DataFrame:
    """doc_id, n_bytes, n_tokens: a row for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = written(piece_counts(distinct_pretokens(docs, path, pattern), path), "pieces")
    least, top = top_by_count(counted, "docs", hot)
    table = top.select("piece", "n").toArrow()  # at most ``hot`` rows
    known = spark.sparkContext.broadcast(dict(zip(table["piece"].to_pylist(), table["n"].to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            sums, rest, sizes = [], [], []
            for text in as_bytes(batch):
                total, other = 0, []
                for piece, n in pretokens(text.decode(), path, pattern).items():
                    if (k := get(piece)) is None:
                        other.append({"piece": piece, "times": n})
                    else:
                        total += n * k
                sums.append(total)
                rest.append(other)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                    pa.array(rest, pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))),
                ],
                names=["doc_id", "n_bytes", "known", "rest"],
            )

    rows = docs.mapInArrow(run, "doc_id long, n_bytes long, known long, rest array<struct<piece: string, times: long>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "doc-pieces")
    rare = counted.filter((F.col("docs") < least) | (F.lit(least) == 0)).select("piece", "n")
    tail = rows.select("row", F.explode("rest").alias("x")).select("row", "x.piece", "x.times").join(rare, "piece")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("other"))
    out = rows.select("row", "doc_id", "n_bytes", "known").join(tail, "row", "left")
    return out.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("other", F.lit(0))).alias("n_tokens"))
