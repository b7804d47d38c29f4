"""Links inside buckets and connected components, without pairs of a whole group.

``bucket_links`` turns buckets of fingerprints into forests: one link for each
member of a component found inside the bucket, never all its pairs.
``components`` joins these forests up by alternating large-star and small-star
steps (Kiveris et al., 2014) on written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CREATED, column, numbers, released, scratch, written

#: Members of a bucket that are compared in one go.
BUCKET = 2048


def hamming_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of the first member of each fingerprint's component at ``radius``.

    fps: uint64, or (n, k) uint64 for wider fingerprints.
    """
    fps = fps.reshape(len(fps), -1)
    root = np.full(len(fps), -1)
    rest = np.arange(len(fps))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        root[seed] = seed
        queue = [seed]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]).sum(axis=1) <= radius
            if near.any():
                found = rest[near]
                root[found] = seed
                queue.extend(found.tolist())
                rest = rest[~near]
    return root


#: A row as it is dealt by key.
_ROW = np.dtype([("key", "<i8"), ("id", "<i8"), ("fp", "<i8"), ("size", "<i4")])
PACKED = "part int, data binary"
#: Rows that a task collects before it deals them out.
PACK = 1 << 18


def parts_of(spark: SparkSession) -> int:
    """Parts that ``packed`` deals keys to: some for each shuffle partition, so that these are about even."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows key, id, fp, size as blocks: part, data. Millions of narrow rows cost a shuffle far more than their bytes."""

    def out(rows: np.ndarray) -> pa.RecordBatch:
        part = (rows["key"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(cuts, len(part)) * _ROW.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), data], names=["part", "data"])

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            some = batch.slice(at, PACK)
            rows = np.empty(some.num_rows, dtype=_ROW)
            for x in _ROW.names:
                rows[x] = numbers(some, x)
            held.append(rows)
            n += len(rows)
            if n >= PACK:
                yield out(np.concatenate(held))
                held, n = [], 0
    if n:
        yield out(np.concatenate(held))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks sorted by part: key, chunk (0), id, fp, size, sorted by (key, id), of the keys that two ids or
    more have. The rows of one part are held together, each id of a key once."""

    def out(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(blocks), dtype=_ROW)
        key, of = rows["key"], rows["id"]
        order = np.argsort(key, kind="stable")
        change = np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])
        order = order[~(change[1:] & change[:-1])]  # keys of one row go before the costlier sort
        order = order[np.lexsort((of[order], key[order]))]
        rows = rows[order]
        rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])])[: len(rows)]]
        change = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1], [True]])[: len(rows) + 1]
        rows = rows[~(change[1:] & change[:-1])] if len(rows) else rows
        if len(rows):
            columns = [pa.array(np.ascontiguousarray(rows[x]).astype(np.int64)) for x in _ROW.names]
            columns.insert(1, pa.array(np.zeros(len(rows), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "chunk", "id", "fp", "size"])

    held: list[bytes] = []
    now = None
    for batch in batches:
        for part, data in zip(column(batch, "part").to_pylist(), column(batch, "data").to_pylist()):
            if held and part != now:
                yield from out(held)
                held = []
            now = part
            held.append(data)
    if held:
        yield from out(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks dealt by part, for ``unpacked``. rows: key, id, fp and, where it counts, size; or blocks made by ``packed`` already."""
    spark = rows.sparkSession
    if rows.columns != ["part", "data"]:
        parts = parts_of(spark)
        size = F.col("size") if "size" in rows.columns else F.lit(0)
        rows = rows.select("key", "id", "fp", size.cast("int").alias("size")).mapInArrow(lambda batches: packed(batches, parts), PACKED)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")


LINKS = "key long, chunk long, a long, b long, over boolean"


def _linker(radius: int, bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (key, chunk): links of runs of up to ``bucket`` rows.

    A longer run passes through with ``over`` set, to be dealt out in blocks.
    At most one run is held in memory, and of a long one only a batch.
    """

    def emit(key, chunk, a, b, over):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (key, chunk, a, b)] + [pa.array(over, pa.bool_())],
            names=["key", "chunk", "a", "b", "over"],
        )

    def run(batches):
        held = np.empty((0, 4), dtype=np.int64)
        long_run = None

        def work(rows, last):
            """Links in rows; returns the rows of a run that may go on."""
            nonlocal long_run
            out = []
            if long_run is not None and len(rows):
                same = (rows[:, 0] == long_run[0]) & (rows[:, 1] == long_run[1])
                n = len(rows) if same.all() else int(np.argmin(same))
                if n:
                    out.append((rows[:n, 0], rows[:n, 1], rows[:n, 2], rows[:n, 3], np.ones(n, bool)))
                    rows = rows[n:]
                if len(rows):
                    long_run = None
            if not len(rows):
                return rows, out
            change = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(rows)))
            keep = rows[:0]
            ends = len(starts) if last else len(starts) - 1
            for k in np.flatnonzero(sizes > 1):
                part = rows[starts[k] : starts[k] + sizes[k]]
                if sizes[k] > bucket:
                    out.append((part[:, 0], part[:, 1], part[:, 2], part[:, 3], np.ones(len(part), bool)))
                    if k >= ends:
                        long_run = (part[0, 0], part[0, 1])
                elif k < ends:
                    root = hamming_components(np.ascontiguousarray(part[:, 3]).view(np.uint64), radius)
                    low = {}
                    for i, r in enumerate(root):
                        low[r] = min(low.get(r, part[i, 2]), part[i, 2])
                    to = np.array([low[r] for r in root], dtype=np.int64)
                    move = to != part[:, 2]
                    n = int(move.sum())
                    if n:
                        out.append((part[move, 0], part[move, 1], part[move, 2], to[move], np.zeros(n, bool)))
            if not last and long_run is None:
                keep = rows[starts[-1] :]
            return keep, out

        for batch in batches:
            rows = np.column_stack([numbers(batch, x).astype(np.int64) for x in ("key", "chunk", "id", "fp")])
            rows = np.concatenate([held, rows])
            # a member may come once for each task that met it
            again = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
            held, out = work(rows[np.concatenate([[True], ~again])[: len(rows)]] if again.any() else rows, False)
            for x in out:
                yield emit(*x)
        _, out = work(held, True)
        for x in out:
            yield emit(*x)

    return run


def bucket_links(rows: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a > b as ids, between fingerprints within ``radius`` that share a key.

    rows: ``key`` long, ``id`` long (of one fingerprint; repeated rows count once), ``fp`` long.
    rows may be blocks that ``packed`` made of these. One shuffle deals blocks by key; runs stream by in sorted order. A run of
    more than ``bucket`` members is dealt anew in blocks: members get a chunk
    by hash and each pair of chunks is one task's work, so that no task holds
    more than two chunks and every pair meets.

    Within a run only a forest is returned; its components are those of the
    run's pairs within the radius. For verification outside, see ``key`` and
    ``chunk``, which say where a link was found.
    """
    link = _linker(radius, bucket)

    first = written(_dealt(rows).mapInArrow(lambda batches: link(unpacked(batches)), LINKS), "links")
    out = first.filter(~F.col("over")).select("key", "chunk", "a", "b")
    big = first.filter("over").select("key", F.col("a").alias("id"), F.col("b").alias("fp"))
    if big.isEmpty():
        return out
    sizes = big.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket // 3)).cast("long").alias("chunks"))
    dealt = (
        big.join(sizes, "key")
        .withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("key", (F.least("c", "o") * F.col("chunks") + F.greatest("c", "o")).alias("chunk"), "id", "fp")
    )
    # chunks are dealt by hash, so two of them can pass the limit a little: double it
    blocks = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "id").mapInArrow(_linker(radius, 2 * bucket), LINKS)
    return out.unionByName(written(blocks.filter(~F.col("over")).select("key", "chunk", "a", "b"), "links"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node that each linked node reaches: columns node, root.

    edges: columns a, b (long). Nodes without an edge are not returned.
    Stars shrink in a number of rounds that grows with the logarithm of the
    graph; each round is cut off by a written table, so no lineage builds up.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = e.join(low, "b").filter("a <> m").select("a", F.col("m").alias("b"))
        large = written(large.distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # a star for each component: no node is both a leaf and a root, one root for each leaf
        e = small
        stats = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("leaves")).first()
        if stats["n"] == stats["leaves"] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def in_rounds(i: np.ndarray, j: np.ndarray, root: Callable[[int], int], judged: Callable[[np.ndarray, np.ndarray], int]) -> None:
    """Has pairs (nearest first) judged until each one is or its ends are connected.

    A round takes a forest of what is not connected yet, which is all that is needed where its
    pairs are the same. Once few are, the rest goes in one round. judged: links pairs, and gives their number.
    """
    while len(i):
        up: dict[int, int] = {}

        def top(x: int, up: dict[int, int] = up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        roots = [(root(x), root(y)) for x, y in zip(i.tolist(), j.tolist())]
        open_ = np.array([u != v for u, v in roots])
        taken = np.zeros(len(i), dtype=bool)
        for k in np.flatnonzero(open_).tolist():
            u, v = top(roots[k][0]), top(roots[k][1])
            if u != v:
                up[u] = v
                taken[k] = True
        if not taken.any():
            return
        n = judged(i[taken], j[taken])
        rest = open_ & ~taken
        i, j = i[rest], j[rest]
        if 4 * n < taken.sum():
            left = np.array([root(x) != root(y) for x, y in zip(i.tolist(), j.tolist())], dtype=bool)
            if left.any():
                judged(i[left], j[left])
            return


def _verifier(same: Callable, prepare: Callable, may: Callable | None = None, apart: int = 64, maybe: Callable | None = None) -> Callable:
    """Links between the members of each group that are the same.

    Members of one label are connected already. Only those are compared whose 64
    bits, where both have them, differ in at most ``apart`` places. may: of
    prepared members, a function that takes a member's place and earlier ones,
    and gives of these those whose members may be the same. A member is compared to the nearest
    earlier ones first and only until it is known to be connected, so a group of like
    members costs about one comparison each. maybe: instead of may, as in ``pair_links``: many pairs are judged at a
    time, first each member and its nearest earlier one, then the near pairs that aren't connected yet; no pair becomes a row.
    """

    def in_turn(payloads: list, bits: np.ndarray, some: np.ndarray, own: np.ndarray, link: Callable, block: int = 512) -> None:
        def distances(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i = np.arange(at, min(at + block, len(bits)))
            j = np.arange(i[-1] + 1)
            d = np.where(some[i][:, None] | some[j], 0, np.bitwise_count(bits[i][:, None] ^ bits[j])).astype(np.int16)
            return i, d, (d <= apart) & (j < i[:, None]) & (own[i][:, None] != own[j])

        def some_judged(i: np.ndarray, j: np.ndarray) -> int:
            n, fit = 0, maybe(payloads, i, j)
            for x, y in zip(i[fit].tolist(), j[fit].tolist()):
                if own[x] != own[y] and same(payloads[x], payloads[y]):
                    link(x, y)
                    n += 1
            return n

        def judged(p: np.ndarray, q: np.ndarray) -> None:
            left = own[p] != own[q]
            p, q = p[left], q[left]
            while len(p):
                in_rounds(p[:JUDGED], q[:JUDGED], lambda x: int(own[x]), some_judged)
                p, q = p[JUDGED:], q[JUDGED:]
                left = own[p] != own[q]
                p, q = p[left], q[left]

        firsts = []
        for at in range(0, len(bits), block):
            i, d, near = distances(at)
            rows = np.flatnonzero(near.any(axis=1))
            firsts.append(np.vstack([i[rows], np.where(near, d, 99)[rows].argmin(axis=1)]))
        judged(*np.concatenate(firsts, axis=1))
        for at in range(0, len(bits), block):
            i, d, near = distances(at)
            p, q = np.nonzero(near)
            order = np.argsort(d[p, q], kind="stable")
            judged(i[p[order]], q[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in column(batch, "m").to_pylist():
                ids, labels = [m["id"] for m in members], [m["label"] for m in members]
                first: dict[int, int] = {}
                own = np.array([first.setdefault(x, k) for k, x in enumerate(labels)])
                if len(first) < 2:
                    continue
                payloads = [prepare(m["payload"]) for m in members]
                bits = np.array([m["fp"] or 0 for m in members], dtype=np.int64).view(np.uint64)
                some = np.array([m["fp"] is None for m in members])
                if maybe is not None:

                    def link(i: int, j: int, own=own, ids=ids) -> None:
                        p, q = sorted((own[i], own[j]))
                        own[own == q] = p
                        a.append(ids[i])
                        b.append(ids[j])

                    in_turn(payloads, bits, some, own, link)
                    continue
                earlier = may(payloads) if may is not None else lambda _, near: near
                for i in range(1, len(ids)):
                    known = ~(some[:i] | some[i])
                    d = np.where(known, np.bitwise_count(bits[:i] ^ bits[i]), 0)
                    near = np.flatnonzero((own[:i] != own[i]) & (d <= apart))
                    near = near[np.argsort(d[near], kind="stable")]
                    step = 8
                    while len(near):
                        for j in earlier(i, near[:step]).tolist():
                            if own[i] != own[j] and same(payloads[i], payloads[j]):
                                p, q = sorted((own[i], own[j]))
                                own[own == q] = p
                                a.append(ids[i])
                                b.append(ids[j])
                        near, step = near[step:], 8 * step
                        near = near[own[near] != own[i]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        released()

    return run


def _labelled(rows: DataFrame, links: DataFrame, of: str = "id") -> DataFrame:
    """rows with ``label``: the root of a member's component under links, itself where it has none."""
    roots = components(links).select(F.col("node").alias(of), "root")
    return rows.join(roots, of, "left").withColumn("label", F.coalesce("root", of)).drop("root")


def group_links(groups: DataFrame, members: DataFrame, same: Callable, prepare: Callable = lambda x: x, block: int = 200, may: Callable | None = None, apart: int = 64, whole: int = 0, maybe: Callable | None = None) -> DataFrame:
    """Links (a, b) between ids of one group whose payloads, each
    prepared once, are the same by ``same``; ``may``, ``apart`` and ``maybe`` as in ``_verifier``.

    groups: g, id, fp (64 bits, or null). members: id, payload. A group of up to ``whole`` members (``block`` at
    least) is verified by one task; a larger one is first verified in parts of that size, and then the first members of what
    is connected so far, in parts again, until these are few or don't get fewer:
    a large group of like members is connected after about one comparison each.
    Members that then still are in different components meet in blocks of two
    parts, so that every pair is compared in some task or connected already.
    """
    spark = groups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    verify = _verifier(same, prepare, may, apart, maybe)
    whole = max(whole, block)

    def linked(dealt: DataFrame) -> DataFrame:
        """dealt: g, chunk, id, fp, label."""
        rows = dealt.join(members, "id").select("g", "chunk", F.struct("id", "label", "fp", "payload").alias("m"))
        met = rows.repartition(parts, "g", "chunk").groupBy("g", "chunk").agg(F.sort_array(F.collect_list("m")).alias("m"))  # few bytes here are much work
        return written(met.select("m").mapInArrow(verify, "a long, b long"), "group-links")

    sizes = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    every = groups.join(sizes, "g")
    own = F.lit(0).cast("long").alias("chunk"), "id", "fp", F.col("id").alias("label")
    links = linked(every.filter(F.col("n") <= whole).select("g", *own))
    large = written(every.filter(F.col("n") > whole).select("g", "id", "fp", "n"), "large-groups")
    if large.isEmpty():
        return links
    of = lambda n, key, salt=0: F.pmod(F.xxhash64(key, F.lit(salt)), F.ceil(n / F.lit(block)).cast("long"))
    # parts of members, then of their representatives
    left, before, bits = large, None, large.select("id", "fp").groupBy("id").agg(F.max("fp").alias("fp"))
    for salt in range(20):
        links = written(links.unionByName(linked(left.select("g", of(F.col("n"), "id", salt).alias("chunk"), "id", "fp", F.col("id").alias("label")))), "group-links")
        roots = _labelled(large.select("g", "id"), links).select("g", F.col("label").alias("id")).distinct()
        left = written(roots.join(roots.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "g").join(bits, "id", "left"), "group-roots")
        most = left.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("rows")).first()
        if not most["rows"]:
            return links
        if most["most"] <= block or before is not None and most["rows"] > 0.7 * before:
            break
        before = most["rows"]
    # what is not connected: parts of one label, or of several that are small; blocks of two parts that differ
    rows = _labelled(large.join(left.select("g").distinct(), "g", "left_semi").select("g", "id", "fp"), links)
    held = rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"))
    rest = held.filter(F.col("k") <= block).groupBy("g").agg(F.sum("k").alias("rest"))
    pure = F.col("k") > block
    part = F.when(pure, F.xxhash64("label", of(F.col("k"), "id"))).otherwise(of(F.coalesce("rest", F.lit(1)), "label"))
    rows = written(rows.join(held, ["g", "label"]).join(rest, "g", "left").select("g", "id", "fp", "label", part.alias("part"), F.when(pure, F.col("label")).alias("only")), "unlinked")
    kinds = written(rows.select("g", "part", "only").distinct(), "parts")
    others = kinds.select("g", F.col("part").alias("other"), F.col("only").alias("other_only"))
    blocks = kinds.join(others, "g").filter((F.col("part") <= F.col("other")) & ~(F.col("only").isNotNull() & F.col("only").eqNullSafe(F.col("other_only"))))
    blocks = blocks.select("g", F.xxhash64("part", "other").alias("chunk"), F.explode(F.array_distinct(F.array("part", "other"))).alias("part"))
    return links.unionByName(linked(rows.join(blocks, ["g", "part"]).select("g", "chunk", "id", "fp", "label")))


PAIRS = "a long, b long, d int, key long, fp long, size long"


def _pairer(apart: int, least: float, small: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by (key, id): the pairs of each run of up to ``small`` rows
    whose 64 bits and sizes are near enough. Rows of longer runs pass through as
    (a: id, key, fp, size), without b. At most one run of up to ``small`` rows is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), dtype=np.int64)
        long_key = None

        def work(rows: np.ndarray, last: bool) -> tuple[np.ndarray, pa.RecordBatch]:
            nonlocal long_key
            change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(rows)))
            long = sizes > small
            if long_key is not None and len(rows) and rows[0, 0] == long_key:
                long[0] = True
            keep = rows[:0]
            if not last and len(rows) and not long[-1]:
                keep, rows, sizes, long = rows[starts[-1] :], rows[: starts[-1]], sizes[:-1], long[:-1]
            elif len(rows):
                long_key = rows[-1, 0] if long[-1] else None
            of, over = np.repeat(np.arange(len(sizes)), sizes), np.repeat(long, sizes)
            prints, lengths = rows[:, 2].view(np.uint64), rows[:, 3]
            found = [np.empty((3, 0), dtype=np.int64)]
            for step in range(1, int(sizes[~long].max(initial=0))):
                i = np.flatnonzero((of[step:] == of[:-step]) & ~over[step:])
                if not len(i):
                    break
                d = np.bitwise_count(prints[i] ^ prints[i + step])
                x, y = lengths[i], lengths[i + step]
                near = (d <= apart) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1)
                i = i[near]
                found.append(np.vstack([rows[i, 1], rows[i + step, 1], d[near]]))
            a, b, d = np.concatenate(found, axis=1)
            n, more = len(a), rows[over]
            nulls = np.concatenate([np.zeros(n, bool), np.ones(len(more), bool)])
            none = np.zeros(len(more), np.int64)
            return keep, pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([a, more[:, 1]])), pa.array(np.concatenate([b, none]), mask=nulls), pa.array(np.concatenate([d, none]).astype(np.int32), mask=nulls),
                    *(pa.array(np.concatenate([np.zeros(n, np.int64), more[:, k]]), mask=~nulls) for k in (0, 2, 3)),
                ],
                names=["a", "b", "d", "key", "fp", "size"],
            )

        for batch in batches:
            rows = np.concatenate([held, np.column_stack([numbers(batch, x).astype(np.int64) for x in ("key", "id", "fp", "size")])])
            if not len(rows):
                continue
            # a member may come once for each task that met it
            again = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            held, out = work(rows[np.concatenate([[True], ~again])], False)
            yield out
        if len(held):
            yield work(held, True)[1]

    return run


def _run_pairs(apart: int, least: float, block: int = 512) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows key, id, fp, size, label sorted by (key, id): of each run, whose rows are held together, the near pairs
    of different labels; without labels (all null) only each member's nearest earlier one."""

    def work(rows: np.ndarray, labels: np.ndarray | None) -> Iterator[np.ndarray]:
        ids, prints, sizes = rows[:, 1], rows[:, 2].view(np.uint64), rows[:, 3]
        for at in range(0, len(rows), block):
            i = np.arange(at, min(at + block, len(rows)))
            j = np.arange(i[-1] + 1)
            d = np.bitwise_count(prints[i][:, None] ^ prints[j]).astype(np.int64)
            x, y = sizes[i][:, None], sizes[j]
            near = (d <= apart) & (j < i[:, None]) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1)
            if labels is None:
                d[~near] = 65
                p, q = np.flatnonzero(near.any(axis=1)), d.argmin(axis=1)
                q = q[p]
            else:
                p, q = np.nonzero(near & (labels[i][:, None] != labels[j]))
            yield np.vstack([np.minimum(ids[i[p]], ids[q]), np.maximum(ids[i[p]], ids[q]), d[p, q]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            for a, b, d in work(rows, rows[:, 4] if rows[0, 5] else None):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

        for batch in batches:
            label = column(batch, "label")
            known = np.full(len(label), int(label.null_count == 0))
            rows = np.column_stack([*(numbers(batch, x).astype(np.int64) for x in ("key", "id", "fp", "size")), label.fill_null(0).to_numpy(), known])
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for part in np.split(rows, cuts):
                if held and len(part) and held[0][0, 0] != part[0, 0]:
                    yield from done()
                if len(part):
                    held.append(part)
        if held:
            yield from done()

    return run


def _wide_pairs(runs: DataFrame, apart: int, least: float) -> DataFrame:
    """a, b, d (distinct): what ``_run_pairs`` finds. runs: key, id, fp, size, label."""
    dealt = runs.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "fp", "size", "label")
    return dealt.mapInArrow(_run_pairs(apart, least), "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def banded_links(
    rows: DataFrame | list[DataFrame], members: Callable[[DataFrame], DataFrame], same: Callable, prepare: Callable, may: Callable, apart: int, least: float, small: int = 64, more: DataFrame | None = None,
    whole: int = 0, wide: int = 0, maybe: Callable | None = None,
) -> DataFrame:
    """Links (a, b) between ids that share a key, whose 64 bits differ in at most
    ``apart`` places and whose sizes by a share of at most 1 - ``least``, and that are the same.

    rows: key, id, fp (64 bits), size; repeated rows count once; or a list of such tables with no key in common,
    which are dealt one after the other, so that the disk holds the shuffle files of one. members: from a
    table of ids (a column id) their id and payload. more: g, id of further
    candidate groups. Runs of up to ``small`` members give their near pairs, at
    most ``small`` for a row; those of one neighbourhood are verified together, so
    that what is known to be connected isn't compared. Longer runs are groups for
    ``group_links``: each one by itself up to ``whole`` members, so that members of
    unlike runs never meet, and those that are longer still and share a member as one. For long
    payloads, ``wide``: runs of up to so many members give pairs too and move no payload,
    first of each member and its nearest earlier one, then the near pairs that
    these don't connect; and payloads are moved in turns. maybe: as in ``pair_links``. Every near pair is compared in one of these ways, or connected already.
    """
    pairer = _pairer(apart, least, small)
    turns = rows if isinstance(rows, list) else [rows]
    found = reduce(DataFrame.unionByName, [written(_dealt(x).mapInArrow(lambda batches: pairer(unpacked(batches)), PAIRS), "near-pairs") for x in turns])
    pairs = written(found.filter("b is not null").groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    long = written(found.filter("b is null").select(F.col("key").alias("g"), F.col("a").alias("id"), "fp", "size"), "long-runs")
    groups = None
    if wide and not long.isEmpty():
        return _wide_links(pairs, long, members, same, prepare, may, apart, least, wide, maybe)
    long = long.drop("size")
    if whole and not long.isEmpty():
        runs = written(long.join(long.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g"), "runs")
        groups, long = runs.filter(F.col("n") <= whole).select("g", "id", "fp"), runs.filter(F.col("n") > whole).select("g", "id", "fp")
    if not long.isEmpty():
        # runs that share a member are one group, so that a member's payload is moved once and not for every key
        firsts = long.groupBy("g").agg(F.min("id").alias("b"))
        roots = components(long.join(firsts, "g").select(F.col("id").alias("a"), "b"))
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        merged = long.groupBy("id").agg(F.max("fp").alias("fp")).join(roots.withColumnRenamed("node", "id"), "id").select(F.col("root").alias("g"), "id", "fp")
        groups = merged if groups is None else groups.unionByName(merged)
    if more is not None:
        more = more.select("g", "id", F.lit(None).cast("long").alias("fp"))
        groups = more if groups is None else groups.unionByName(more)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if groups is not None:
        groups = written(groups.distinct(), "groups")
        ids = ids.unionByName(groups.select("id"))
    texts = written(members(written(ids.distinct(), "ids")).dropDuplicates(["id"]), "payloads")
    links = pair_links(pairs, texts, same, prepare, maybe=maybe)
    return links if groups is None else links.unionByName(group_links(groups, texts, same, prepare, may=may, apart=apart, whole=whole, maybe=maybe))


def _wide_links(
    pairs: DataFrame, long: DataFrame, members: Callable, same: Callable, prepare: Callable, may: Callable, apart: int, least: float, wide: int, maybe: Callable | None
) -> DataFrame:
    """``banded_links`` with ``wide``. pairs: of short runs; long: g, id, fp, size."""
    spark = pairs.sparkSession

    def verified(some: DataFrame) -> DataFrame:
        with scratch(spark) as keep:
            ids = written(some.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
            out = pair_links(some, written(members(ids).dropDuplicates(["id"]), "payloads"), same, prepare, turns=True, maybe=maybe)
            keep.append(CREATED[-1])
        return out

    runs = written(long.join(long.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g"), "runs")
    held = runs.filter(F.col("n") <= wide).withColumnRenamed("g", "key")
    first = _wide_pairs(held.withColumn("label", F.lit(None).cast("long")), apart, least)
    first = written(pairs.unionByName(first).groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    links = verified(first)
    rest = _wide_pairs(_labelled(held, links).select("key", "id", "fp", "size", "label"), apart, least)
    rest = written(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.unionByName(verified(rest))
    over = runs.filter(F.col("n") > wide)
    if over.isEmpty():
        return links
    firsts = over.groupBy("g").agg(F.min("id").alias("b"))
    merged = _labelled(over.select("id", "fp"), over.join(firsts, "g").select(F.col("id").alias("a"), "b"))
    merged = written(merged.groupBy("id").agg(F.max("fp").alias("fp"), F.min("label").alias("g")), "groups")
    texts = written(members(written(merged.select("id"), "ids")).dropDuplicates(["id"]), "payloads")
    return links.unionByName(group_links(merged.select("g", "id", "fp"), texts, same, prepare, may=may, apart=apart))


#: Members whose pairs ``maybe`` judges at a time.
JUDGED = 4096


def pair_links(pairs: DataFrame, members: DataFrame, same: Callable, prepare: Callable, turns: bool = False, maybe: Callable | None = None) -> DataFrame:
    """Links (a, b) among pairs (a, b, d) whose payloads are the same, nearest first.
    turns: in as many turns as a payload is moved times on average, each with its share of the neighbourhoods.
    maybe: of prepared members and the places of the two ends of many pairs, which pairs may be the same.

    Pairs are dealt by the least neighbour of their two ends, with each payload
    once: the pairs of a small group of copies meet there, and those that are
    connected already aren't compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: tuple[list[int], list[int]] = ([], [])
            held, n = [], 0
            for m, p in zip(column(batch, "m").to_pylist(), column(batch, "p").to_pylist()):
                held.append((m, p))
                n += len(m)
                if n >= JUDGED:
                    linked_of(held, links)
                    held, n = [], 0
            linked_of(held, links)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
        released()

    def linked_of(held: list[tuple[list, list]], links: tuple[list[int], list[int]]) -> None:
        every: list = []
        asked = []  # of each neighbourhood (a, b, places of both) for its pairs, nearest first
        for m, p in held:
            at = {x["id"]: len(every) + k for k, x in enumerate(m)}
            every.extend(x["payload"] for x in m)
            asked.append([(x["a"], x["b"], at[x["a"]], at[x["b"]]) for x in sorted(p, key=lambda x: (x["d"], x["a"], x["b"]))])
        done = [prepare(x) for x in every]
        if maybe is not None:
            if any(asked):
                rounds_of(done, [x["id"] for m, _ in held for x in m], asked, links)
            return
        for p in asked:
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b, i, j in p:
                u, v = find(a), find(b)
                if u != v and same(done[i], done[j]):
                    root[max(u, v)] = min(u, v)
                    links[0].append(a)
                    links[1].append(b)

    def rounds_of(done: list, ids: list[int], asked: list[list], links: tuple[list[int], list[int]]) -> None:
        """As below, many neighbourhoods at a time: a payload has a place in each of its own."""
        up = list(range(len(done)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def judged(i: np.ndarray, j: np.ndarray) -> int:
            n, fit = 0, maybe(done, i, j)
            for x, y in zip(i[fit].tolist(), j[fit].tolist()):
                u, v = find(x), find(y)
                if u != v and same(done[x], done[y]):
                    up[max(u, v)] = min(u, v)
                    links[0].append(ids[x])
                    links[1].append(ids[y])
                    n += 1
            return n

        in_rounds(*np.array([x[2:] for p in asked for x in p]).T, find, judged)

    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lows")
    rooted = pairs.join(low, "a").join(low.select(F.col("a").alias("b"), F.col("low").alias("low_b")), "b")
    rooted = written(rooted.select(F.least("low", "low_b").alias("g"), "a", "b", "d"), "rooted")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(rooted: DataFrame) -> DataFrame:
        texts = rooted.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().join(members, "id")
        texts = texts.repartition(parts, "g").groupBy("g").agg(F.collect_list(F.struct("id", "payload")).alias("m"))
        asked = rooted.repartition(parts, "g").groupBy("g").agg(F.collect_list(F.struct("a", "b", "d")).alias("p"))
        return written(texts.join(asked, "g").select("m", "p").mapInArrow(run, "a long, b long"), "pair-links")

    if not turns:
        return linked(rooted)
    moves = rooted.select("g", F.explode(F.array("a", "b")).alias("id")).distinct().count()
    n = max(1, -(-moves // max(1, members.count())))
    turn = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(n))
    links = [linked(rooted.filter(turn == k)) for k in range(n)]
    return written(reduce(DataFrame.unionByName, links), "pair-links")


def fingerprint_groups(found: DataFrame) -> DataFrame:
    """g, fp: the components inside buckets, each once however many buckets have it.
    found: what ``bucket_links`` returns."""
    rows = found.select("key", "chunk", "b", F.col("a").alias("fp")).unionByName(found.select("key", "chunk", "b", F.col("b").alias("fp")).distinct())
    sets = rows.groupBy("key", "chunk", "b").agg(F.sort_array(F.collect_set("fp")).alias("fps")).select("fps").distinct()
    return sets.select(F.xxhash64("fps").alias("g"), F.explode("fps").alias("fp"))
