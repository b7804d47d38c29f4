"""Byte-level BPE encoding and decoding by recursive queries of DuckDB.

A text is cut into words by the vocabulary's pattern. The distinct words of a
task that its worker doesn't know yet become rows (word, position, token), one
for each byte, and a recursive query contracts them: rows are joined with their
right neighbours to the merge table, each word's leftmost pair of least rank is
contracted, and words without a pair leave the recursion; it ends at the
fixpoint. The merge table has every pair of tokens whose concatenation is a
token. Ids of a text are those of its words in order; decoding joins ids to
their bytes and aggregates them in order, again in DuckDB.

A round writes the rows of every word that is still going, so a word's cost
grows with the square of its length. Words of more than ``SHORT`` bytes thus go
through the same query in units of ``UNIT`` bytes, whose seams are then checked:
a sequence of tokens is a text's contraction if and only if every two
neighbours, contracted alone, stay as they are (the first contraction over a
boundary would also take place in these two). Where they don't, the tokens
around the seam are contracted again as one unit, twice as many at each failure.
A query takes ``AT_ONCE`` bytes at most, so its memory is bounded whatever the
words are.

Defined cases: null text counts as empty, which has no ids and decodes to
nothing; a text is never cut by length; rows that repeat a document get one row
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column

#: Bytes of a word up to which it is contracted as a whole, and of the units of longer ones.
SHORT, UNIT = 40, 24
#: Words in each of the two generations that a worker keeps the ids of.
CACHE = 600_000
#: Characters of texts that are encoded together.
GROUP = 1 << 22
#: Bytes of words that one recursive query contracts (one word at least).
AT_ONCE = 300_000
#: Tokens that one query decodes.
TOKENS = 250_000

#: A place packs a pair's rank, its position and its right neighbour's, so that
#: the least one is the leftmost pair of least rank and says what goes.
CONTRACT = """
with recursive step(word, pos, token, going) as (
  select word, pos, token, true from bytes
  union all
  (with pairs as (
     select word, pos, token, lead(pos) over o as next_pos, token * {size} + lead(token) over o as pair
     from step where going window o as (partition by word order by pos)),
   ranked as (
     select word, pos, token, rank * {size} + pos * {span} + next_pos as place
     from pairs left join merges using (pair)),
   least as (select word, min(place) as best from ranked group by word)
   select word, pos, case when place = best then best // {size} else token end, best is not null
   from ranked join least using (word)
   where best is null or pos <> best % {span}))
select word, list(token order by pos) as ids from step where not going group by word
"""

DECODE = """
select ids.text, string_agg(hex(vocabulary.bytes), '' order by ids.pos) as bytes
from ids join vocabulary using (token) group by ids.text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.cut = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.db.execute("set preserve_insertion_order = false")
        # positions take 8 bits each; ids of up to 16 bits leave a pair and a place in 32
        self.kind, size = ("uinteger", 1 << 16) if len(self.ranks) <= 1 << 16 else ("ubigint", 1 << 24)
        self.contraction = CONTRACT.format(size=f"{size}::{self.kind}", span=f"256::{self.kind}")
        # a unit of longer bytes, which a seam can grow to, has positions of 18 bits
        self.long_contraction = CONTRACT.format(size=f"{size}::ubigint", span=f"{1 << 18}::ubigint")
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left * size + right)
                    ranks.append(rank)
        self.db.register("merge_rows", pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int64())}))
        self.db.execute(f"create table merges as select pair::{self.kind} as pair, rank::{self.kind} as rank from merge_rows")
        tokens = pa.table({"token": pa.array(self.ranks.values(), pa.int64()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        self.db.register("token_rows", tokens)
        self.db.execute("create table vocabulary as select * from token_rows")
        self.db.unregister("merge_rows")
        self.db.unregister("token_rows")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, by the recursive query, ``AT_ONCE`` bytes at a time."""
        out: list[bytes] = []
        i = 0
        while i < len(words):
            j, held = i, 0
            while j < len(words) and (j == i or held + len(words[j]) <= AT_ONCE):
                held += len(words[j])
                j += 1
            out += self._contract(words[i:j])
            i = j
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        long = sizes.max() > 255
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        number = np.uint32 if self.kind == "uinteger" and not long else np.uint64
        rows = {"word": np.repeat(np.arange(len(words)), sizes), "pos": pos, "token": self.byte_ids[flat]}
        self.db.register("bytes", pa.table({k: x.astype(number) for k, x in rows.items()}))
        table = self.db.sql(self.long_contraction if long else self.contraction).to_arrow_table()
        self.db.unregister("bytes")
        out: list[bytes] = [b""] * len(words)
        ids = table.column("ids").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        ends = ids.offsets.to_numpy().tolist()
        data = ids.values.to_numpy().astype("<u4").tobytes()
        for k, w in enumerate(table.column("word").to_pylist()):
            out[w] = data[4 * ends[k] : 4 * ends[k + 1]]
        return out

    def contract_long(self, words: list[bytes]) -> list[bytes]:
        """The same for words of any length, by units whose seams are checked."""
        units: dict[bytes, list[int]] = {}

        def know(wanted: set[bytes]) -> None:
            new = sorted(wanted.difference(units))
            units.update((u, np.frombuffer(x, dtype="<u4").tolist()) for u, x in zip(new, self.contract(new)))

        know({w[i : i + UNIT] for w in words for i in range(0, len(w), UNIT)})
        # a word is a list of parts, each a contraction of its own; between two of them is a seam, with the number of
        # tokens of either side that the next failure takes
        parts = [[units[w[i : i + UNIT]] for i in range(0, len(w), UNIT)] for w in words]
        seams = [[1] * (len(p) - 1) for p in parts]
        going = [k for k, s in enumerate(seams) if s]
        text = self.bytes_of
        while going:
            know({text[p[i][-1]] + text[p[i + 1][0]] for p in (parts[k] for k in going) for i in range(len(p) - 1)})
            failed: list[list[bool]] = []
            wanted: set[bytes] = set()
            for k in going:
                p, bad = parts[k], []
                for i, n in enumerate(seams[k]):
                    left, right = p[i], p[i + 1]
                    # of two failures beside one part only the first is mended in a round
                    fails = units[text[left[-1]] + text[right[0]]] != [left[-1], right[0]]
                    bad.append(fails)
                    if fails and not (i and bad[i - 1] == "mend"):
                        bad[-1] = "mend"
                        wanted.add(b"".join(text[t] for t in (*left[-n:], *right[:n])))
                failed.append(bad)
            know(wanted)
            for k, bad in zip(going, failed):
                parts[k], seams[k] = self._mended(parts[k], seams[k], bad, units)
            going = [k for k in going if seams[k]]
        return [np.array(p[0], dtype="<u4").tobytes() for p in parts]

    def _mended(self, parts: list[list[int]], seams: list[int], bad: list, units: dict[bytes, list[int]]) -> tuple[list[list[int]], list[int]]:
        """Parts joined at the seams that hold and contracted again at those that are mended."""
        text = self.bytes_of
        out, left = [list(parts[0])], []
        used = False  # whether the part on the left went into a unit as a whole, so that its seam is another now
        for n, fails, before, part in zip(seams, bad, parts, parts[1:]):
            if fails is True or used:
                out.append(list(part))
                left.append(n)
                used = False
            elif not fails:
                out[-1] += part
            else:
                size = min(n, len(before))
                head, tail, rest = out[-1][:-size], out[-1][-size:], part[n:]
                middle = units[b"".join(text[t] for t in (*tail, *part[:n]))]
                out.pop()
                if head:
                    out.append(head)
                    left.append(2 * n)
                out.append(list(middle))
                if rest:
                    out.append(list(rest))
                    left.append(2 * n)
                used = not rest
        return out, left

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {}, self.known
            new = words
        known, older, ranks = self.known, self.older, self.ranks
        if older:
            again = new.intersection(older)
            known.update((w, older[w]) for w in again)
            new = new.difference(again)
        short: dict[str, bytes] = {}
        long: dict[str, bytes] = {}
        for w in new:
            if (rank := ranks.get(b := w.encode())) is not None:
                known[w] = rank.to_bytes(4, "little")  # a word that is a token is that token
            else:
                (short if len(b) <= SHORT else long)[w] = b
        known.update(zip(short, self.contract(list(short.values()))))
        known.update(zip(long, self.contract_long(list(long.values()))))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids (little-endian, 32 bits) of each text."""
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= GROUP):
                held += len(texts[j])
                j += 1
            words = [self.cut.findall(t) for t in texts[i:j]]
            self.learn(set().union(*words))
            known = self.known
            for ws in words:
                yield b"".join([known[w] for w in ws])
            i = j

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids, by an ordered aggregation; long sequences by several."""
        out: list[list[bytes]] = [[] for _ in texts]
        pieces = [(k, x[i : i + 4 * TOKENS]) for k, x in enumerate(texts) for i in range(0, len(x), 4 * TOKENS)]
        i = 0
        while i < len(pieces):
            j, held = i, 0
            while j < len(pieces) and (j == i or held + len(pieces[j][1]) // 4 <= TOKENS):
                held += len(pieces[j][1]) // 4
                j += 1
            part = [x for _, x in pieces[i:j]]
            sizes = np.array([len(x) // 4 for x in part])
            flat = np.frombuffer(b"".join(part), dtype="<u4").astype(np.int64)
            rows = pa.table({"text": np.repeat(np.arange(len(part)), sizes), "pos": np.arange(len(flat)), "token": flat})
            self.db.register("ids", rows)
            table = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            found = dict(zip(table.column("text").to_pylist(), table.column("bytes").to_pylist()))
            for k in range(len(part)):
                out[pieces[i + k][0]].append(bytes.fromhex(found[k]))
            i = j
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = list(c.encode([x.decode() for x in as_bytes(batch)]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return _columns(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, from doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = c.decode([x or b"" for x in as_bytes(batch, "ids")])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding, then decoding of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = list(c.encode([x.decode() for x in as_bytes(batch)]))
            back = [hashlib.sha256(x).hexdigest() for x in c.decode(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
