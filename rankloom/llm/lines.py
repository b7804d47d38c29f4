"""Fuzzy line deduplication.

Lines (split at \\n) are normalised (lower case, white space collapsed), and
equal ones are grouped by a 128-bit hash. Distinct lines get a 64-bit SimHash of
their distinct words (a sign repeated between cells weighs no more than a word);
the hash is cut into ``blocks`` blocks, and lines that agree on all but
``radius`` blocks meet in some bucket by the pigeonhole principle. Inside a
bucket, lines within ``radius`` bits are candidates. One replaced word moves a
short line's SimHash by more bits than that, so lines also meet by bands of
min-hashes of their character n-grams, in which an edit weighs little, and are
candidates if 64 bits of these min-hashes differ in ``apart`` places at most.
Candidates' texts are fetched and linked if their edit similarity, 1 - distance /
longer length, is ``similarity`` or more. Of each connected group the occurrence
with the smallest (doc_id, line number) stays; every other occurrence is
removed, within and across documents.

Texts are read twice and never shuffled unless the list of documents to change
outgrows a checked size: rows of hashes move instead.

Defined cases: null text counts as empty; lines without a word always stay;
null ``doc_id`` sorts after all others; rows that repeat doc_id and text are
one document and are treated alike; an empty table gives an empty result;
further columns are ignored; a document may lose all its lines and stays, with
an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, carried, carried_names, carried_schema, column, keyed, numbers, released, sized, with_row, written
from .graph import PACKED, banded_links, bucket_links, components, fingerprint_groups, packed, parts_of
from .sketch import band_keys, bin_minima, one_bits

LINE_SCHEMA = "rid long, doc_id long, line int, h1 long, h2 long, fp long, fuzzy boolean, keys array<long>"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is larger (bit-parallel, Myers 1999)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    shorter = min(len(a), len(b))
    while i < shorter and a[i] == b[i]:
        i += 1
    j = 0
    while j < shorter - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        d = len(a) + len(b)
        return d if d <= most else most + 1
    n = len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    plus, minus, score = full, 0, n
    for k, c in enumerate(b):
        eq = at.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - (len(b) - 1 - k) > most:
            return most + 1
        up = up << 1 | 1
        down <<= 1
        plus = (down | ~(diag | up)) & full
        minus = up & diag & full
    return score if score <= most else most + 1


#: Buckets of a text's bigram counts.
BIGRAMS = 512


def with_bigrams(text: str) -> tuple[str, np.ndarray]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return text, np.bincount((codes[:-1] * np.uint32(31) ^ codes[1:]) & np.uint32(BIGRAMS - 1), minlength=BIGRAMS).astype(np.int32)


def anchored_distance(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance, or ``most`` + 1: the sum over the gaps
    between words that both texts have once, in one order."""
    x, y = a.split(" "), b.split(" ")
    once = {w for w, n in Counter(x).items() if n == 1}
    at = {w: j for j, w in enumerate(y) if w in once}
    again = {w for w, n in Counter(w for w in y if w in at).items() if n > 1}
    pairs = [(i, at[w]) for i, w in enumerate(x) if w in at and w not in again]
    # the longest run of pairs that rises in both texts
    ends: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        back.append(ends[n - 1] if n else -1)
        if n == len(ends):
            ends.append(k)
            tops.append(j)
        else:
            ends[n], tops[n] = k, j
    chain, k = [(len(x), len(y))], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    total, i, j = 0, 0, 0
    for u, v in reversed(chain):
        if x[i:u] != y[j:v]:
            total += edit_distance("".join(w + " " for w in x[i:u]), "".join(w + " " for w in y[j:v]), most - total)
            if total > most:
                return most + 1
        i, j = u + 1, v + 1
    return total


def similar(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], similarity: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``similarity``."""
    longer = max(len(a[0]), len(b[0]))
    most = int((1 - similarity) * longer + 1e-9)
    lost = longer - 1 - int(np.minimum(a[1], b[1]).sum())
    if lost > 2 * most:  # as in ``screen``
        return False
    # most pairs are near copies, which the bound shows at a fraction of the cost; where many bigrams differ it would only add to it
    return (lost <= most and anchored_distance(a[0], b[0], most) <= most) or edit_distance(a[0], b[0], most) <= most


def screen(members: list[tuple[str, np.ndarray]], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """For a member, those of some others that may be similar to it: an edit changes two
    bigrams at most, so similar texts have that many in common (Ukkonen, 1992). Loses none."""
    sizes = np.array([len(t) for t, _ in members])
    counts = np.stack([c for _, c in members])

    def may(i: int, near: np.ndarray) -> np.ndarray:
        longer = np.maximum(sizes[near], sizes[i])
        most = np.floor((1 - similarity) * longer + 1e-9)
        fit = np.abs(sizes[near] - sizes[i]) <= most
        near, longer, most = near[fit], longer[fit], most[fit]
        common = np.minimum(counts[near], counts[i]).sum(axis=1)
        return near[common >= longer - 1 - 2 * most]

    return may


#: Steps after which ``far`` judges, its pairs and their 64-character words at a time, and the longest text that it takes.
STRIDE, TOGETHER, CELLS, LONGEST = 32, 512, 4096, 4096
_W = np.uint64


def _kinds(texts: list[str], width: int) -> np.ndarray:
    """(n, width): a kind below 64 for each character, 255 after the end."""
    out = np.full((len(texts), width), 255, dtype=np.uint8)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") & np.uint32(63)
    return out


def far(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Of pairs of texts, those whose edit distance is over ``most`` for certain (each a is the shorter).

    Bit-parallel distances (Myers, 1999) of all pairs at a time, characters being of 64 kinds, which makes
    none larger. A pair is far once each cell of a column, with what the rest's lengths ask for, is over ``most``:
    for unlike texts after about a third. Cells that lie further than ``most`` off the diagonal aren't needed.
    """
    n = len(a)
    out = np.zeros(n, dtype=bool)
    la, lb = (np.array([len(x) for x in y]) for y in (a, b))
    words = -(-int(la.max()) // 64)
    x, y = _kinds(a, 64 * words), np.ascontiguousarray(_kinds(b, int(lb.max())).T)
    at = np.zeros((64, n, words), dtype=_W)
    for k in np.unique(x[x < 64]).tolist():
        at[k] = np.packbits(x == k, axis=1, bitorder="little").view("<u8")
    plus, minus = np.full((words, n), ~_W(0)), np.zeros((words, n), dtype=_W)
    left, reach, one = np.arange(n), int(most.max()), _W(1)
    for j in range(len(y)):
        last = min(words, (j + reach) // 64 + 1)
        eqs = at[y[j] & 63, np.arange(len(left)), :last].T
        up, down = np.ones(len(left), dtype=_W), np.zeros(len(left), dtype=_W)
        for w in range(last):
            eq, p, m = eqs[w], plus[w], minus[w]
            vert = eq | m
            eq = eq | down
            hor = (((eq & p) + p) ^ p) | eq
            more, less = m | ~(hor | p), p & hor
            next_up, next_down = more >> _W(63), less >> _W(63)
            more, less = more << one | up, less << one | down
            plus[w], minus[w] = less | ~(vert | more), more & vert
            up, down = next_up, next_down
        if (j + 1) % STRIDE and j + 1 < len(y):
            continue
        # cells (i, j) of the column, i from 0, as far as they count
        rows = 64 * last
        p, m = (np.unpackbits(np.ascontiguousarray(z[:last].T).view(np.uint8), axis=1, bitorder="little").astype(np.int32) for z in (plus, minus))
        cells = np.concatenate([np.zeros((len(left), 1), np.int32), np.cumsum(p - m, axis=1, dtype=np.int32)], axis=1) + (j + 1)
        rest = np.abs((la[left, None] - np.arange(rows + 1)) - (lb[left, None] - (j + 1)))
        cells = np.where(np.arange(rows + 1) <= la[left, None], cells + rest, 1 << 30)
        gone = (cells.min(axis=1) > most[left]) & (lb[left] > j)
        out[left[gone]] = True
        stay = ~gone & (lb[left] > j + 1)  # a text that has ended is left to the exact distance
        if not stay.any():
            break
        if not stay.all():
            left, plus, minus, at, y = left[stay], plus[:, stay], minus[:, stay], at[:, stay], y[:, stay]
    return out


def may_be_similar(members: list[tuple[str, np.ndarray]], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of members may be similar, by their bigrams and, where these leave it open, by ``far``. Loses none."""
    sizes = np.array([len(t) for t, _ in members])
    counts = np.stack([c for _, c in members])
    longer, shorter = np.maximum(sizes[i], sizes[j]), np.minimum(sizes[i], sizes[j])
    most = np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)
    common = np.concatenate([np.minimum(counts[i[k : k + 4096]], counts[j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096)])
    lost = longer - 1 - common
    fit = (longer - shorter <= most) & (lost <= 2 * most)
    open_ = np.flatnonzero(fit & (lost > most) & (shorter >= STRIDE) & (longer <= LONGEST))
    open_ = open_[np.argsort(longer[open_], kind="stable")]
    k, words = 0, longer // 64 + 1
    while k < len(open_):
        # by the longest of them, so that memory doesn't grow with the length of texts
        n = min(TOGETHER, len(open_) - k, max(8, CELLS // int(words[open_[k]])))
        n = min(n, max(8, CELLS // int(words[open_[k + n - 1]])))
        some = open_[k : k + n]
        texts = [sorted((members[x][0], members[y][0]), key=len) for x, y in zip(i[some].tolist(), j[some].tolist())]
        fit[some] = ~far([x for x, _ in texts], [y for _, y in texts], most[some])
        k += n
    return fit


#: The eight bits of a byte, first one first, in the eight bytes of an integer.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhash_runs(digests: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
    """SimHash of each run of ``sizes`` (none 0) 8-byte digests, as signed 64-bit integers.

    Bits are counted eight to an integer, in stretches of at most 255 digests.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    rows = digests.reshape(-1, 8)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        base = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, base + chunk, side="right")))
        n = sizes[i:j]
        parts = -(-n // 255)
        first = np.cumsum(parts) - parts
        starts = np.repeat(ends[i:j] - n - base, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
        counts = np.add.reduceat(_SPREAD[rows[base : ends[j - 1]]], starts, axis=0)
        ones = np.add.reduceat(counts.view(np.uint8).astype(np.int32), first, axis=0)
        out[i:j] = np.packbits(2 * ones > n[:, None], axis=1).view(">i8").ravel()
        i = j
    return out


#: (n, least, most): the n of lines of that many characters. The spans overlap, so that
#: the lines of any pair whose lengths differ by up to a fifth have one n in common.
GRAMS = ((3, 1, 39), (6, 32, 1 << 62))
#: Min-hashes of a band.
BAND_ROWS = 4
#: Bands whose keys are dealt at a time.
TURN = 8
#: Members of a long run that one task compares.
WHOLE = 4096
#: Distinct lines that a task remembers to sketch a line once.
REMEMBERED = 100_000


def gram_hashes(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """uint32 hashes of the n-grams of each line (of n - 2 characters at least)
    between two spaces, and how many each line has."""
    codes = np.frombuffer(f" {' '.join(lines)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    grams = np.zeros(len(codes) - n + 1, dtype=np.uint32)
    for k in range(n):
        grams = grams * np.uint32(0x9E3779B1) ^ codes[k : len(grams) + k]
        grams ^= grams >> np.uint32(15)
    grams = (grams ^ grams >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    grams = (grams ^ grams >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    grams ^= grams >> np.uint32(16)
    sizes = np.array([len(x) for x in lines])
    counts = sizes + 3 - n
    # n-grams that reach over the end of a line go
    own = np.ones(len(grams), dtype=bool)
    ends = np.cumsum(sizes + 1)[:-1]
    for k in range(2, n):
        at = ends - n + k
        own[at[(at >= 0) & (at < len(grams))]] = False
    return grams[own], counts


def line_rows(docs: DataFrame, fuzzy_words: int = 1, bands: int = 16, chunk: int = 1 << 17) -> DataFrame:
    """A row for each line with a word, and ``keys``: the band keys, each with 64 bits
    of the same min-hashes, where a task has the line's text for the first time. docs: rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        digest, word_digest = xxhash.xxh3_128_digest, xxhash.xxh64_digest
        for batch in batches:
            rids, ids = column(batch, "rid").to_pylist(), column(batch, "doc_id").to_pylist()
            rid, doc, no, digests, sizes, fuzzy, hashes = [], [], [], [], [], [], []
            new: list[tuple[int, str]] = []
            for r, d, text in zip(rids, ids, as_bytes(batch)):
                text = text.lower() if text.isascii() else text.decode().lower().encode()
                for k, line in enumerate(text.split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    norm = b" ".join(words)
                    digests.append(digest(norm))
                    fuzzy.append(len(words) >= fuzzy_words)
                    if fuzzy[-1]:
                        words = set(words)
                        hashes.append(b"".join(map(word_digest, words)))
                        sizes.append(len(words))
                        if digests[-1] not in seen:
                            seen.add(digests[-1])
                            new.append((len(rid), norm.decode()))
                    rid.append(r)
                    doc.append(d)
                    no.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            if not rid:
                continue
            pairs = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
            fp = np.zeros(len(rid), dtype=np.int64)
            flags = np.array(fuzzy)
            if flags.any():
                fp[flags] = simhash_runs(np.frombuffer(b"".join(hashes), dtype=np.uint8), np.array(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid, pa.int64()), pa.array(doc, pa.int64()), pa.array(no, pa.int32()),
                    pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(fp), pa.array(flags), keys_of(len(rid), new),
                ],
                names=["rid", "doc_id", "line", "h1", "h2", "fp", "fuzzy", "keys"],
            )
        seen.clear()
        released()

    def keys_of(n_rows: int, new: list[tuple[int, str]]) -> pa.Array:
        """Of each row a list of (band keys and, after them, the 64 bits and the length) for each n of the line."""
        rows, values = [np.empty(0, np.int64)], [np.empty((0, bands + 2), np.int64)]
        for n, least, most in GRAMS:
            some = [(at, x) for at, x in new if least <= len(x) <= most]
            i = 0
            while i < len(some):
                j, size = i, 0
                while j < len(some) and (j == i or size + len(some[j][1]) <= chunk):
                    size += len(some[j][1])
                    j += 1
                minima = bin_minima(*gram_hashes([x for _, x in some[i:j]], n), bands * BAND_ROWS)
                rows.append(np.array([at for at, _ in some[i:j]]))
                values.append(np.column_stack([band_keys(minima, BAND_ROWS, n), one_bits(minima), [len(x) for _, x in some[i:j]]]))
                i = j
        at, flat = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n_rows))]) * (bands + 2)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order].ravel()))

    return docs.select("rid", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, LINE_SCHEMA)


def band_rows(lines: DataFrame, bands: int = 16, first: int = 0, last: int | None = None) -> DataFrame:
    """key, id (h1), fp (the 64 bits), size (length) of each band, from ``first`` to before ``last``, of each line's min-hashes, in blocks."""
    last = bands if last is None else last
    parts = parts_of(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "keys")
            sets = np.diff(lists.offsets.to_numpy()) // (bands + 2)
            values = lists.flatten().to_numpy().reshape(-1, bands + 2)
            ids = np.repeat(np.repeat(numbers(batch, "h1"), sets), last - first)
            prints, sizes = (np.repeat(values[:, bands + k], last - first) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(values[:, first:last].ravel()), pa.array(ids), pa.array(prints), pa.array(sizes)], names=["key", "id", "fp", "size"])

    return lines.filter("size(keys) > 0").select("h1", "keys").mapInArrow(lambda batches: packed(run(batches), parts), PACKED)


def block_rows(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """key, id, fp (both the fingerprint), size (0) for each mask of each fingerprint, in blocks."""
    parts = parts_of(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = numbers(batch, "fp").astype(np.int64)
            keys = [(fps & np.int64(m)).view(_W) ^ _W(k + 1 << 20) for k, m in enumerate(masks)]
            keys = np.concatenate(keys) * _W(0x9E3779B97F4A7C15)
            keys = (keys ^ keys >> _W(32)) * _W(0xD6E8FEB86659FD93)
            every = pa.array(np.tile(fps, len(masks)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), every, every, pa.array(np.zeros(len(keys), np.int32))], names=["key", "id", "fp", "size"])

    return nodes.select("fp").mapInArrow(lambda batches: packed(run(batches), parts), PACKED)


def block_keys(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """A mask for each choice of blocks that a pair within ``radius`` bits may share."""
    from itertools import combinations

    cuts = [bits * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fuzzy_links(docs: DataFrame, lines: DataFrame, distinct: DataFrame, radius: int, blocks: int, similarity: float, bands: int, apart: int) -> DataFrame:
    """Links (a, b) between the h1 of similar lines. lines: h1, keys; distinct: h1, fp, fuzzy, first."""
    fuzzy = distinct.filter("fuzzy")
    # lines of one fingerprint are one node here and all become members below
    nodes = fuzzy.groupBy("fp").agg(F.count(F.lit(1)).alias("same"))
    nodes = written(nodes, "line-prints")
    found = bucket_links(block_rows(nodes, block_keys(blocks, radius)), radius)
    alone = nodes.filter("same > 1").select(F.xxhash64("fp").alias("g"), "fp")
    prints = written(fingerprint_groups(found).unionByName(alone), "line-groups")
    groups = fuzzy.join(sized(prints), "fp").select("g", F.col("h1").alias("id"))
    groups = written(groups, "line-members")
    if groups.isEmpty():
        groups = None

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = written(fuzzy.join(sized(ids.withColumnRenamed("id", "h1")), "h1", "left_semi").select("h1", "first"), "line-wanted")
        by_doc = wanted.groupBy("first.rid", "first.doc_id").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1")).alias("lines"))
        texts = with_row(docs, sized(written(by_doc, "line-docs"), 200_000, "lines"), "inner").select(F.col("text").cast("binary").alias("text"), "lines")
        return texts.mapInArrow(wanted_lines, "id long, payload string")

    # keys of unlike bands never meet
    turns = [band_rows(lines, bands, k, min(k + TURN, bands)) for k in range(0, bands, TURN)]
    return banded_links(
        turns, texts_of, lambda a, b: similar(a, b, similarity), with_bigrams, lambda m: screen(m, similarity), apart, similarity, more=groups,
        whole=WHOLE, maybe=lambda m, i, j: may_be_similar(m, i, j, similarity),
    )


def wanted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, payload: the normalised lines that are asked for; each text is split once. Over text, lines (line, h1)."""
    for batch in batches:
        ids, out = [], []
        for text, lines in zip(as_bytes(batch), column(batch, "lines").to_pylist()):
            text = text.lower() if text.isascii() else text.decode().lower().encode()
            every = text.split(b"\n")
            for x in lines:
                ids.append(x["h1"])
                out.append(b" ".join(every[x["line"]].split()).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "payload"])


def line_groups(
    docs: DataFrame, similarity: float = 0.8, radius: int = 2, blocks: int = 4, fuzzy_words: int = 1, bands: int = 16, apart: int = 26
) -> tuple[DataFrame, DataFrame]:
    """The lines (rid, doc_id, line, h1, h2) and, for each line text that occurs
    again or is linked, the occurrence that stays: h1, h2, keep (struct)."""
    lines = written(line_rows(docs, fuzzy_words, bands), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "line")
    distinct = written(
        lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), F.max("fuzzy").alias("fuzzy")), "line-texts"
    )
    roots = components(fuzzy_links(docs, lines, distinct, radius, blocks, similarity, bands, apart))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = written(roots.withColumnRenamed("node", "h1").join(distinct.select("h1", "h2", "first"), "h1"), "line-roots")
    kept = linked.join(linked.groupBy("root").agg(F.min("first").alias("keep")), "root").select("h1", "h2", "keep")
    again = distinct.filter("n > 1").select("h1", "h2", F.col("first").alias("keep")).join(kept, ["h1", "h2"], "left_anti")
    return lines, again.unionByName(kept)


def dedup_lines(
    docs: DataFrame, similarity: float = 0.8, radius: int = 2, blocks: int = 4, fuzzy_words: int = 1, carry: Sequence[str] = (), bands: int = 16, apart: int = 26
) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, n_removed and the
    columns to carry: a row for each row of docs."""
    rows = keyed(docs, carry)
    lines, keep = line_groups(rows, similarity, radius, blocks, fuzzy_words, bands, apart)
    gone = (
        lines.drop("keys")
        .join(written(keep, "line-keep"), ["h1", "h2"])
        .filter(~((F.col("rid") == F.col("keep.rid")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line"))))
        .groupBy("rid", "doc_id")
        .agg(F.array_distinct(F.collect_list("line")).alias("gone"))
    )
    gone = sized(written(gone, "line-gone"), 200_000, "gone")
    cols = with_row(rows, gone, "left").withColumn("text", F.col("text").cast("binary"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for text, gone in zip(as_bytes(batch), column(batch, "gone").to_pylist()):
                lines.append(text.count(b"\n") + 1)
                removed.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in drop)
                texts.append(text)
            extra, names = carried(batch, carry)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int32()), pa.array(removed, pa.int32()), *extra],
                names=["doc_id", "text", "n_lines", "n_removed", *names],
            )

    return cols.mapInArrow(without, carried_schema("doc_id long, text string, n_lines int, n_removed int", docs, carry)).withColumnsRenamed(carried_names(carry))
