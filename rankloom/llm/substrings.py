"""Substring deduplication with a log-structured fingerprint index.

Words covered by a window of ``window`` consecutive words that also starts in a
document with a smaller doc_id are removed. Every window has an anchor: the
least hash among its sub-windows of ``window`` / 2 words (winnowing; Schleimer
et al., 2003). Equal windows have equal anchors, so only windows whose anchor
occurs in two different texts can repeat, and a text has about one distinct
anchor for each ``window`` / 4 words.

The index keeps the anchors of the texts seen so far as immutable runs: tables
bucketed and sorted by anchor, one for each batch. A new batch's anchors are
sorted the same way and merge-joined to the runs; nothing of the history is
shuffled again. ``save`` and ``load`` carry an index from session to session. Anchors found in two texts are candidates. All their windows,
of the batch and of the history, are then verified by 128 bits of hash of all
their words (a second polynomial beside the anchor's), and the smallest doc_id
of each window decides. Every ``fanout`` runs of a level are compacted to one
of the next, and their files deleted.

Texts equal as a whole are matched first by a 128-bit hash, so a group of
copies enters the index once, however large it is.

Defined cases: null text has no words; a document of fewer words than a window
is left alone; a null ``doc_id`` counts as larger than all others; rows with
equal doc_id don't remove words from each other; an empty table gives an empty
result; further columns are ignored; a document may lose all its words and
stays, with an empty text. In a text that loses words, the words that stay and
the white space after each stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, carried, carried_names, carried_schema, column, deleted, keyed, shared_folder, sized, with_row, written

_U = np.uint64
#: Words that are hashed in one go.
CHUNK = 1 << 18
_LAST = 2**63 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of all windows of words: polynomials modulo 2^64 of word hashes."""

    def __init__(self, base: int):
        self.base, self.powers, self.inverses = base | 1, np.ones(1, _U), np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            self.powers, self.inverses = (self._powers(x, n) for x in (self.base, pow(self.base, -1, 1 << 64)))

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        factors = np.full(n, x, dtype=_U)
        factors[0] = 1
        return np.cumprod(factors, dtype=_U)

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        self._grow(len(words) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * self.powers[: len(words)], dtype=_U)])
        return _mix((sums[k:] - sums[:-k]) * self.inverses[: len(words) - k + 1])


_small, _whole = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1B54A32D192ED03)


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each k consecutive values."""
    size, out = 1, x
    while 2 * size <= k:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - size : k - size + len(x) - k + 1]) if size < k else out


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype="<u8")


def window_anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window."""
    small = window // 2
    return sliding_least(_small.windows(hashes, small), window - small + 1)


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    return _whole.windows(hashes, window), _small.windows(hashes, window)


def text_rows(docs: DataFrame, window: int) -> DataFrame:
    """rid, doc_id, n_words, t1, t2 (hash of the whole text), anchors: the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, anchors, sizes = [], [], [], [0]
            for text in as_bytes(batch):
                words = text.split()
                n.append(len(words))
                whole.append(xxhash.xxh3_128_digest(b" ".join(words)))
                found = np.unique(window_anchors(word_hashes(words), window)) if len(words) >= window else np.empty(0, _U)
                anchors.append(found.view(np.int64))
                sizes.append(sizes[-1] + len(found))
            t = np.frombuffer(b"".join(whole), dtype=">i8").astype(np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*anchors, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rid"), column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(t[:, 0]), pa.array(t[:, 1]), lists],
                names=["rid", "doc_id", "n_words", "t1", "t2", "anchors"],
            )

    cols = docs.select("rid", "doc_id", F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(run, "rid long, doc_id long, n_words long, t1 long, t2 long, anchors array<long>")


def candidate_windows(texts: DataFrame, window: int) -> DataFrame:
    """h1, h2, rid, doc_id, start, new of each window with one of the text's wanted anchors.
    texts: rid, doc_id, text, wanted, new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, docs = column(batch, "rid").to_pylist(), column(batch, "doc_id").to_pylist()
            held, n = [], 0

            def out(held):
                names = ["h1", "h2", "rid", "doc_id", "start", "new"]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)

            for rid, doc, text, wanted, new in zip(rids, docs, as_bytes(batch), column(batch, "wanted").to_pylist(), column(batch, "new").to_pylist()):
                hashes = word_hashes(text.split())
                at = np.flatnonzero(np.isin(window_anchors(hashes, window).view(np.int64), np.array(wanted, dtype=np.int64)))
                h1, h2 = window_hashes(hashes, window)
                held.append((h1[at].view(np.int64), h2[at].view(np.int64), np.full(len(at), rid), np.full(len(at), doc), at.astype(np.int32), np.full(len(at), new)))
                n += len(at)
                if n >= CHUNK:
                    yield out(held)
                    held, n = [], 0
            if held:
                yield out(held)

    cols = texts.select("rid", "doc_id", F.col("text").cast("binary").alias("text"), "wanted", "new")
    return cols.mapInArrow(run, "h1 long, h2 long, rid long, doc_id long, start int, new boolean")


class WindowIndex:
    """Runs of anchors and whole-text hashes of all documents added so far."""

    def __init__(self, spark, window: int = 50, fanout: int = 4, buckets: int | None = None):
        self.spark, self.window, self.fanout = spark, window, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # level, table
        self.seen: DataFrame | None = None  # t1, t2, first
        self.store: DataFrame | None = None  # rid, doc_id, text of all batches
        self.seen_at: list[str] = []
        self.texts_at: list[str] = []

    def _path(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/rankloom/{name}"

    def _write_run(self, rows: DataFrame, level: int) -> None:
        name = f"rankloom_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor")
            .option("path", self._path(name)).saveAsTable(name)
        )
        self.runs.append((level, name))

    def drop(self) -> None:
        """Delete the index's own tables."""
        for _, name in self.runs:
            self.spark.sql(f"drop table if exists {name}")
            deleted(self.spark, self._path(name))
        for path in self.seen_at:
            deleted(self.spark, path)

    def save(self, path: str) -> None:
        """Writes where the index's tables are; they stay in the shared folder. ``load`` goes on from there."""
        tables = [(level, "run", name, self._path(name)) for level, name in self.runs]
        tables += [(0, kind, "", p) for kind, ps in (("seen", self.seen_at), ("texts", self.texts_at)) for p in ps]
        rows = [(self.window, self.fanout, self.buckets, *t) for t in tables]
        self.spark.createDataFrame(rows, "window int, fanout int, buckets int, level int, kind string, name string, path string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "WindowIndex":
        rows = spark.read.parquet(path).collect()
        index = cls(spark, rows[0]["window"], rows[0]["fanout"], rows[0]["buckets"])
        for r in rows:
            if r["kind"] == "run":
                if not spark.catalog.tableExists(r["name"]):
                    columns = "rid bigint, doc_id bigint, anchor bigint"
                    spark.sql(f"create table {r['name']} ({columns}) using parquet clustered by (anchor) sorted by (anchor) into {index.buckets} buckets location '{r['path']}'")
                index.runs.append((r["level"], r["name"]))
            elif r["kind"] == "seen":
                index.seen_at, index.seen = [r["path"]], spark.read.parquet(r["path"])
            else:
                index.texts_at.append(r["path"])
                part = spark.read.parquet(r["path"])
                index.store = part if index.store is None else index.store.unionByName(part)
        return index

    def _compact(self) -> None:
        for level in sorted({k for k, _ in self.runs}):
            same = [name for k, name in self.runs if k == level]
            if len(same) >= self.fanout:
                rows = self.spark.table(same[0])
                for name in same[1:]:
                    rows = rows.unionByName(self.spark.table(name))
                self.runs = [(k, name) for k, name in self.runs if k != level]
                self._write_run(rows, level + 1)
                for name in same:
                    self.spark.sql(f"drop table {name}")
                    deleted(self.spark, self._path(name))

    def add(self, docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Add a batch (rid, doc_id, text; a scan of stored texts, which the index
        reads again where later batches share an anchor). path: the Parquet table
        of these three columns, where the index is to be saved. Returns, for its texts that
        have a window, rid, doc_id and copy (whether an equal text has a smaller
        doc_id), and its repeated windows (rid, doc_id, starts)."""
        texts = written(text_rows(docs, self.window).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST))), "texts")
        own = texts.filter(F.col("n_words") >= self.window)
        firsts = own.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
        if self.seen is not None:
            before = self.seen.select("t1", "t2", F.col("first").alias("before"))
            firsts = firsts.join(before, ["t1", "t2"], "left").select("t1", "t2", F.least("first", "before").alias("first"))
        firsts = written(firsts, "firsts")
        marked = own.join(firsts, ["t1", "t2"]).select(
            "rid", "anchors", "doc_id", (F.col("doc_id") == F.col("first.doc_id")).alias("only"), (F.col("doc_id") > F.col("first.doc_id")).alias("copy")
        )
        marked = written(marked, "marked")
        # of each group of equal texts, those of the smallest doc_id enter
        anchors = marked.filter("only").dropDuplicates(["rid", "doc_id"]).select("rid", "doc_id", F.explode("anchors").alias("anchor"))
        earlier = [self.spark.table(name) for _, name in self.runs]
        self._write_run(anchors, 0)
        new = self.spark.table(self.runs[-1][1])
        each = new.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        shared = each.filter("n > 1").select("anchor")
        for run in earlier:  # a merge join of two sorted, equally bucketed tables
            shared = shared.unionByName(each.join(run, "anchor", "left_semi").select("anchor"))
        shared = written(shared.distinct() if earlier else shared, "shared")
        hits = new.join(shared, "anchor").withColumn("new", F.lit(True))
        for run in earlier:
            hits = hits.unionByName(run.join(shared, "anchor").withColumn("new", F.lit(False)))
        wanted = written(hits.groupBy("rid", "doc_id", "new").agg(F.collect_set("anchor").alias("wanted")), "wanted")
        self.store = docs if self.store is None else self.store.unionByName(docs)
        self.texts_at += [path] if path else []
        source = with_row(self.store.withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST))), sized(wanted, 200_000, "wanted"), "inner")
        windows = written(candidate_windows(source, self.window), "windows")
        least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
        # written first, so that both sides of the join are plain exchanges, which adaptive execution splits where a window is in very many documents
        least = written(least.select("h1", "h2", "least"), "least")
        repeated = windows.filter("new").join(least, ["h1", "h2"]).filter("doc_id > least")
        starts = repeated.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_set("start")).alias("s"))
        # of a run of starts, its ends and every window-th start cover the same words
        near = lambda x, i, k: F.coalesce(F.abs(F.get("s", i + k) - x) > 1, F.lit(True))
        starts = starts.select("rid", "doc_id", F.filter("s", lambda x, i: near(x, i, -1) | near(x, i, 1) | (x % self.window == 0)).alias("starts"))
        starts = written(starts, "starts")
        seen = firsts if self.seen is None else self.seen.unionByName(firsts).groupBy("t1", "t2").agg(F.min("first").alias("first"))
        before = self.seen_at
        self.seen_at = [self._path(f"seen-{uuid.uuid4().hex}")]
        seen.write.parquet(self.seen_at[0])
        self.seen = self.spark.read.parquet(self.seen_at[0])
        for path in before:
            deleted(self.spark, path)
        self._compact()
        return marked.select("rid", "doc_id", "copy").dropDuplicates(["rid", "doc_id"]), starts


_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*")


def covered(starts: list[int], window: int, n: int) -> np.ndarray:
    """Which of n words some window covers."""
    delta = np.zeros(n + 1, dtype=np.int32)
    at = np.array(starts, dtype=np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + window, -1)
    return np.cumsum(delta[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = 50, batches: int = 2, fanout: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_sha256 and the columns to carry: a row for each row of docs.

    Documents go through a ``WindowIndex`` in batches of about equal size by
    ranges of doc_id, smaller ones first.
    """
    rows = keyed(docs, carry)
    index = WindowIndex(docs.sparkSession, window, fanout)
    copies = starts = None
    shares = [k / batches for k in range(1, batches)]
    cuts = [int(x) for x in rows.select("doc_id").filter("doc_id is not null").stat.approxQuantile("doc_id", shares, 0.01)] if shares else []
    cuts = cuts or [0] * len(shares)  # no row with an id
    for k in range(batches):
        part = F.lit(True)
        if k:
            part &= F.coalesce("doc_id", F.lit(_LAST)) > cuts[k - 1]
        if k < batches - 1:
            part &= F.coalesce("doc_id", F.lit(_LAST)) <= cuts[k]
        c, s = index.add(rows.select("rid", "doc_id", "text").filter(part))
        copies = c if copies is None else copies.unionByName(c)
        starts = s if starts is None else starts.unionByName(s)
    every = copies.filter("copy").select("rid", "doc_id", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    gone = every.unionByName(starts.select("rid", "doc_id", F.lit(False).alias("copy"), "starts"))
    gone = written(gone.groupBy("rid", "doc_id").agg(F.max("copy").alias("copy"), F.first("starts", ignorenulls=True).alias("starts")), "gone")
    index.drop()
    there = sized(gone, 200_000, "starts").withColumnsRenamed({"rid": "found_rid", "doc_id": "found_doc"})
    same = (F.col("rid") == F.col("found_rid")) & (F.coalesce("doc_id", F.lit(_LAST)) == F.col("found_doc"))
    cols = rows.withColumn("text", F.col("text").cast("binary")).join(there, same, "left").drop("found_rid", "found_doc")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, n, removed, shas = [], [], [], []
            for text, copy, at in zip(as_bytes(batch), column(batch, "copy").to_pylist(), column(batch, "starts").to_pylist()):
                words = text.split()
                n.append(len(words))
                if copy:
                    removed.append(len(words))
                    words, text = [], b""
                elif at:
                    keep = ~covered(at, window, len(words))
                    removed.append(int((~keep).sum()))
                    text = b"".join([w for w, k in zip(_WORD.findall(text), keep) if k])
                    words = text.split()
                else:
                    removed.append(0)
                texts.append(text)
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            extra, names = carried(batch, carry)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), *extra],
                names=["doc_id", "text", "n_words", "n_removed", "kept_sha256", *names],
            )

    schema = carried_schema("doc_id long, text string, n_words long, n_removed long, kept_sha256 string", docs, carry)
    return cols.mapInArrow(run, schema).withColumnsRenamed(carried_names(carry))
