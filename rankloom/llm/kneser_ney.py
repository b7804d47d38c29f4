"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over byte 4-grams and learns from every trusted document. Counts,
continuation counts, context totals and discounts (Chen and Goodman, 1999) are
tables sharded by n-gram; joining them from the shortest order up gives the
log probability of every n-gram that the corpus holds, whether or not the
trusted texts do. A document's perplexity joins its n-grams to these: the
``hot`` most frequent n-grams (a bounded table, found from the histogram of
counts) are broadcast, all others are joined by shuffling the documents'
remaining n-gram frequencies. A document is kept if its perplexity is at most
the ``quantile`` of its language's trusted documents, each of which is scored by
the model of the other ``folds``, so that no threshold is taken from texts that
its model has seen. The error of a mean over n n-grams falls with sqrt(n): log
perplexities are compared after ``allowance`` / sqrt(n) is taken off, in the
quantile as in the verdict.

Log probabilities are integers of 1/UNIT, so sums don't depend on the order of
rows. Nothing is sampled or capped.

Defined cases: a null text, or one of fewer than 4 bytes, has no n-gram, a null
perplexity, and is rejected; languages (null included) with fewer than
``least`` trusted documents use the quantile of all languages together;
without trusted documents nothing is rejected but such texts; rows that repeat
a document get one row each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, column, keyed, released, sized, top_by_count, written
from .rules import byte_grams, marked, per_text, text_chunks

ORDER = 4
UNIT = 1_000_000
#: N-grams kept by a task before it passes its counts on.
FLUSH = 1 << 20


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n, t: occurrences in all and in trusted texts. docs: text (binary), trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), dtype=np.int64)

        def merge(parts):
            grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros((2, len(grams)), dtype=np.int64)
            for k in range(2):
                n[k] = np.bincount(where, weights=np.concatenate([p[k + 1] for p in parts]), minlength=len(grams))
            return np.vstack([grams, n])

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y)) for y in x], names=["gram", "n", "t"])

        for batch in batches:
            texts, flags = as_bytes(batch), column(batch, "trusted").to_numpy(zero_copy_only=False).astype(bool)
            for i, part in text_chunks(texts):
                grams, counts = byte_grams(part)
                trusted = np.repeat(flags[i : i + len(part)], counts)
                a, n = np.unique(grams[~trusted], return_counts=True)
                b, t = np.unique(grams[trusted], return_counts=True)
                held = merge([held, np.vstack([a, n, 0 * n]).astype(np.int64), np.vstack([b, t, t]).astype(np.int64)])
                if held.shape[1] > FLUSH:
                    yield out(held)
                    held = held[:, :0]
        yield out(held)
        released()

    rows = docs.select("text", "trusted").mapInArrow(run, "gram long, n long, t long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts."""
    seen = {row["c"]: row["k"] for row in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (seen.get(k, 0) for k in range(1, 5))
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def log_probabilities(counted: DataFrame) -> DataFrame:
    """gram, n, value: the integer log probability of every n-gram's last byte after its first three."""
    counts = counted.filter("t > 0").select("gram", F.col("t").alias("c"))
    orders = []
    for order in range(ORDER, 0, -1):
        counts = written(counts, f"counts{order}")
        orders.append((order, counts))
        # continuation counts: in how many n-grams a suffix ends
        counts = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    below = None
    for order, c in reversed(orders):
        d1, d2, d3 = discounts(c)
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftright("gram", 8).alias("context")
        c = c.select("gram", context, "c", off.alias("off"))
        totals = c.groupBy("context").agg(F.sum("c").alias("total"), F.sum(F.least("off", "c")).alias("left"))
        full = (1 << 8 * order) - 1
        if below is None:
            wanted = c.sparkSession.range(256).select(F.col("id").alias("gram"), F.lit(1 / 256).alias("lower"))
        else:
            wanted = counted.select(F.col("gram").bitwiseAND(F.lit(full)).alias("gram")).distinct()
            wanted = wanted.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(full >> 8))).join(below, "suffix").select("gram", "lower")
        rows = (
            wanted.withColumn("context", F.shiftright("gram", 8))
            .join(totals, "context", "left")
            .join(c.select("gram", "c", "off"), "gram", "left")
        )
        seen = F.greatest(F.coalesce(F.col("c") - F.col("off"), F.lit(0.0)), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((seen + F.col("left") * F.col("lower")) / F.col("total"))
        below = written(rows.select(F.col("gram").alias("suffix"), p.alias("lower")), f"model{order}")
    value = F.round(F.log("lower") * UNIT).cast("long")
    return counted.select("gram", "n").join(below.withColumnRenamed("suffix", "gram"), "gram").select("gram", "n", value.alias("value"))


class Lookup:
    """Values of n-grams by a hash table in two arrays, and the few that collide there."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = min(22, max(8, 2 + int(len(grams)).bit_length()))
        self.keys = np.full(1 << self.bits, np.iinfo(np.int64).max, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        first = np.unique(self.slot(grams.astype(np.uint32)), return_index=True)[1]
        self.keys[self.slot(grams[first].astype(np.uint32))] = grams[first]
        self.values[self.slot(grams[first].astype(np.uint32))] = values[first]
        rest = np.setdiff1d(np.arange(len(grams)), first)
        order = rest[np.argsort(grams[rest])]
        self.more, self.more_values = grams[order], values[order].astype(np.int32)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which n-grams are known (value 0 elsewhere)."""
        slot = self.slot(grams)
        found = self.keys[slot] == grams
        out = np.where(found, self.values[slot], 0)
        if len(self.more) and not found.all():
            miss = np.flatnonzero(~found)
            at = np.minimum(np.searchsorted(self.more, grams[miss]), len(self.more) - 1)
            hit = self.more[at] == grams[miss]
            out[miss[hit]] = self.more_values[at[hit]]
            found[miss[hit]] = True
        return out, found


def perplexities(docs: DataFrame, trusted: DataFrame, hot: int = 1 << 19) -> DataFrame:
    """rid, doc_id, lang, trusted, n_grams, log_sum: a row for each row of docs (a written table)."""
    spark = docs.sparkSession
    docs = keyed(docs, ["lang"]).select("rid", "doc_id", F.col("text").cast("binary").alias("text"), F.col("carried_lang").cast("string").alias("lang"))
    docs = marked(docs, trusted)
    model = written(log_probabilities(written(gram_counts(docs), "grams")), "model")
    least, top = top_by_count(model, "n", hot)
    table = top.select("gram", "value").toArrow()  # at most ``hot`` rows
    shared = spark.sparkContext.broadcast((table["gram"].to_numpy(), table["value"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(*shared.value)
        for batch in batches:
            sums, sizes, rare, times, rests = ([np.empty(0, np.int64)] for _ in range(5))  # of the whole batch
            for _, part in text_chunks(as_bytes(batch)):
                grams, counts = byte_grams(part)
                values, found = known.get(grams)
                sums.append(per_text(values, counts))
                sizes.append(counts)
                owner = np.repeat(np.arange(len(part)), counts)[~found]
                pairs, n = np.unique(owner << 32 | grams[~found].astype(np.int64), return_counts=True)
                rare.append(pairs & 0xFFFFFFFF)
                times.append(n)
                rests.append(np.bincount(pairs >> 32, minlength=len(part)))
            structs = pa.StructArray.from_arrays([pa.array(np.concatenate(rare)), pa.array(np.concatenate(times))], names=["gram", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rests))]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rid"), column(batch, "doc_id"), column(batch, "lang"), column(batch, "trusted"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums)), rest],
                names=["rid", "doc_id", "lang", "trusted", "n_grams", "known", "rest"],
            )
        released()

    rows = docs.mapInArrow(run, "rid long, doc_id long, lang string, trusted boolean, n_grams long, known long, rest array<struct<gram: long, times: long>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "doc-grams")
    rare = model.filter((F.col("n") < least) | (F.lit(least) == 0)).select("gram", "value")
    tail = rows.select("row", F.explode("rest").alias("x")).select("row", "x.gram", "x.times").join(rare, "gram")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("other"))
    out = rows.drop("rest").join(tail, "row", "left")
    return written(out.select("rid", "doc_id", "lang", "trusted", "n_grams", (F.col("known") + F.coalesce("other", F.lit(0))).alias("log_sum")), "perplexities")


def thresholds(scored: DataFrame, quantile: float, least: int) -> tuple[DataFrame, float | None]:
    """lang, most: the quantile of log perplexity of each language's trusted
    documents, and that of all languages, from histograms of 1/1000 steps."""
    steps = scored.filter("trusted and cost is not null").groupBy("lang", F.ceil(F.col("cost") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    steps = written(steps, "steps")

    def cut(df, *by):
        up = Window.partitionBy(*by).orderBy("step")
        every = Window.partitionBy(*by)
        df = df.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(every))
        return df.filter(F.col("upto") >= quantile * F.col("total")).groupBy(*by, "total").agg((F.min("step") / 1000).alias("most"))

    every = steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    row = cut(every, "all").first()
    each = cut(steps.filter("lang is not null"), "lang").filter(F.col("total") >= least).select("lang", "most")
    return each, row["most"] if row else None


def held_out(docs: DataFrame, trusted: DataFrame, folds: int, hot: int) -> DataFrame:
    """Like ``perplexities``, for the trusted documents only: each under the model of the other folds' trusted documents."""
    fold = F.pmod(F.col("doc_id").cast("long"), F.lit(folds))
    good = trusted.select("doc_id").filter("doc_id is not null").distinct()
    own = written(docs.select("doc_id", "text", "lang").join(sized(written(good, "good")), "doc_id", "left_semi"), "trusted-texts")
    out = None
    for k in range(folds):
        part = perplexities(own, good.filter(fold != k), hot).filter(fold == k).withColumn("trusted", F.lit(True))
        out = part if out is None else out.unionByName(part)
    return out


def classify(
    docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, least: int = 20, hot: int = 1 << 19, allowance: float = 1.0, folds: int = 2
) -> DataFrame:
    """rid, doc_id, lang, perplexity, threshold, kept: a row for each row of docs."""
    cost = F.when(F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams") / UNIT)
    short = F.lit(allowance) / F.sqrt(F.greatest("n_grams", F.lit(1)))
    scored = perplexities(docs, trusted, hot).withColumn("cost", cost)
    # what a short text is allowed is taken off before the quantile, and given again after it
    each, every = thresholds(held_out(docs, trusted, folds, hot).withColumn("cost", cost - short), quantile, least)
    most = F.coalesce(F.col("most"), F.lit(every).cast("double")) + short
    out = scored.join(sized(written(each, "limits")), "lang", "left").withColumn("limit", most)
    kept = F.col("cost").isNotNull() & (F.col("limit").isNull() | (F.col("cost") <= F.col("limit")))
    return out.select("rid", "doc_id", "lang", F.exp("cost").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))
