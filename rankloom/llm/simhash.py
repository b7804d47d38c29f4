"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's 64-bit SimHash takes the majority of each bit over the XXH64 of
its word shingles. Pairs within ``radius`` bits are found with the covering
masks of Pagh (2016): every bit position i gets a nonzero vector m(i) of
radius + 1 bits, and each nonzero v gives a mask that keeps the positions with
<m(i), v> = 1. Any ``radius`` vectors leave some v orthogonal to all of them,
so a pair that differs in at most ``radius`` positions agrees on the whole of
some mask: no pair is missed, with 2^(radius + 1) - 1 tables.

Only distinct fingerprints enter the tables, so copies cost one row each and a
group of copies is never expanded. Links inside a bucket form a forest (see
``graph.bucket_links``) and components are joined up on written tables.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; fewer words than the shingle make one shingle of the whole sequence; a
null ``doc_id`` is kept and never names a component unless its group holds no
other; rows that repeat a document get one row each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, keyed, numbers, sized, with_row, written
from .graph import banded_links, bucket_links, components, fingerprint_groups
from .sketch import band_keys, bin_minima, one_bits

SEED = 42


def shingle_digests(words: list[bytes], shingle: int) -> list[bytes]:
    """XXH64 of each shingle, big-endian; fewer words give one shingle."""
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]


def simhash(digests: list[bytes], block: int = 1 << 16) -> int:
    """The majority of each bit, as a signed 64-bit integer."""
    if not digests:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(digests), block):
        part = np.frombuffer(b"".join(digests[i : i + block]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 5, distinct: bool = False, carry: tuple | list = ()) -> DataFrame:
    """doc_id, fp (long), n_words, and further long columns to carry. Letters A-Z are lower-cased; words end at
    ASCII white space. distinct: count each shingle of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, counts = [], []
            for text in as_bytes(batch):
                words = (text or b"").lower().split()
                digests = shingle_digests(words, shingle)
                fps.append(simhash(list(set(digests)) if distinct else digests))
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(fps, pa.int64()), pa.array(counts, pa.int64()), *(column(batch, c) for c in carry)],
                names=["doc_id", "fp", "n_words", *carry],
            )

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carry)
    return cols.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", "n_words", *carry]))


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks, as signed 64-bit integers."""
    dims = radius + 1
    vectors = [1 + i % ((1 << dims) - 1) for i in range(bits)]
    masks = []
    for v in range(1, 1 << dims):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def covering_rows(fps: DataFrame, radius: int) -> DataFrame:
    """A row (key, id, fp) for each distinct fingerprint and mask."""
    tables = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(covering_masks(radius))])
    return fps.select(F.explode(tables).alias("key"), F.col("fp").alias("id"), "fp")


def linked_components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fp, component_id: smallest doc_id over all fingerprints reachable from fp
    by steps of at most ``radius`` bits. prints: doc_id, fp (a written table).
    """
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(bucket_links(covering_rows(firsts, radius), radius))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    roots = written(roots.withColumnRenamed("node", "fp").join(firsts, "fp"), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def simhash_groups(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """A row for each document: doc_id, fp, component_id."""
    prints = written(fingerprints(docs, shingle), "simhash")
    # a hot fingerprint's rows are dealt out by adaptive skew handling
    return prints.join(linked_components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, payload: the sorted distinct hashes of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [b"".join(sorted(set(shingle_digests((t or b"").lower().split(), shingle)))) for t in as_bytes(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(sets, pa.binary())], names=["id", "payload"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, payload binary")


#: Min-hashes of a band of a text's shingles.
BAND_ROWS = 5


def shingle_bands(docs: DataFrame, shingle: int, bands: int, chunk: int = 1 << 18) -> DataFrame:
    """key, id, fp, size: keys from min-hashes of each text's shingles, 64 bits of them, and the
    number of distinct shingles. Two texts of Jaccard similarity j agree on some key with
    probability 1 - (1 - j^BAND_ROWS)^bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            sets: list[np.ndarray] = []

            def out():
                sizes = np.array([len(x) for x in sets])
                minima = bin_minima(np.concatenate(sets), sizes, bands * BAND_ROWS)
                own = [np.repeat(x, bands) for x in (np.array(ids, dtype=np.int64), one_bits(minima), sizes)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (band_keys(minima, BAND_ROWS, 0).ravel(), *own)], names=["key", "id", "fp", "size"])

            n = 0
            for i, t in zip(numbers(batch, "id").tolist(), as_bytes(batch)):
                digests = set(shingle_digests((t or b"").lower().split(), shingle))
                if digests:
                    ids.append(i)
                    sets.append(np.frombuffer(b"".join(digests), dtype=">u4")[::2].astype(np.uint32))
                    n += len(digests)
                if n >= chunk:
                    yield out()
                    ids, sets, n = [], [], 0
            if ids:
                yield out()

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, id long, fp long, size long")


def jaccard(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    x, y = np.frombuffer(a, dtype=">u8"), np.frombuffer(b, dtype=">u8")
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / (len(x) + len(y) - same)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4, bands: int = 20, apart: int = 20) -> DataFrame:
    """rid, doc_id, component_id, keep: documents linked by a Jaccard similarity
    of ``similarity`` or more of their word shingles; the row with the smallest
    (doc_id, rid) of each group has ``keep``. A row for each distinct (doc_id, text).

    Candidates are pairs within ``radius`` bits of a SimHash of each text's
    distinct words, in which an edited word weighs one feature and not a whole
    shingle's; the covering masks find all of these. Near copies can lie further
    apart, so texts that agree on one of ``bands`` min-hash keys of their shingles
    are candidates too, if 64 bits of the min-hashes differ in ``apart`` places at
    most: a pair of Jaccard similarity 0.8 is missed by all keys with a
    probability of 0.0004, and its bits differ in 6.4 places on average, with a
    deviation of 2.4. Candidates are verified on their whole shingle sets.
    """
    rows = keyed(docs).withColumn("id", F.xxhash64("text"))
    prints = fingerprints(rows, 1, distinct=True, carry=["rid", "id"])
    prints = written(prints.dropDuplicates(["rid", "doc_id"]), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    texts = written(prints.groupBy("id").agg(F.min(place).alias("first"), F.min("fp").alias("fp")), "texts")
    nodes = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("same"))
    found = bucket_links(covering_rows(nodes.select("fp"), radius), radius)
    alone = nodes.filter("same > 1").select(F.xxhash64("fp").alias("g"), "fp")
    groups = written(fingerprint_groups(found).unionByName(alone), "groups").join(texts, "fp").select("g", "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = texts.join(sized(ids), "id", "left_semi").select("id", "first.rid", "first.doc_id")
        asked = with_row(rows.select("rid", "doc_id", "text"), sized(written(wanted, "wanted")), "inner")
        return shingle_sets(asked.select("id", "text"), shingle)

    # equal texts of two ids can't be: an id is a text's hash
    links = banded_links(
        shingle_bands(rows.select("id", "text"), shingle, bands), sets_of, lambda a, b: jaccard(a, b) >= similarity, bytes, sizes_near(similarity), apart, similarity, more=groups
    )
    roots = components(links)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    roots = written(roots.join(texts.select("id", "first"), "id"), "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("named")), "root").select("id", "named")
    every = texts.join(named, "id", "left").select("id", F.coalesce("named", "first").alias("named"))
    keep = (F.col("rid") == F.col("named.rid")) & F.col("doc_id").eqNullSafe(F.col("named.doc_id"))
    return prints.join(every, "id").select("rid", "doc_id", F.col("named.doc_id").alias("component_id"), keep.alias("keep"))


def sizes_near(similarity: float) -> Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]:
    """Of sets, those whose sizes allow that similarity."""

    def may(sets: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
        sizes = np.array([len(x) for x in sets])
        return lambda i, near: near[np.minimum(sizes[near], sizes[i]) >= similarity * np.maximum(sizes[near], sizes[i]) - 1e-9]

    return may
