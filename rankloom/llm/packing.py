"""Packing documents into sequences of fixed length by the sum of squares.

A document becomes its token ids and an end id. One longer than a sequence is
cut into full pieces and a rest; nothing else is cut. Pieces are dealt by hash
into shards of about ``shard`` pieces, and each shard is packed by itself, long
pieces first: a piece goes where the sum over gaps of the squared number of
open sequences with that gap becomes smallest (Csirik et al., 2006), a new
sequence being one of the choices. The open sequences that the shards leave
are packed again, as whole blocks, in rounds of fewer shards.

Token ids come from the vocabulary's own library, once for each distinct
pre-token of a worker; texts outside the plain Latin range go through the
library whole. Full-length pieces make a sequence each.

Defined cases: null text counts as empty and makes one piece, the end id alone;
rows that repeat a document are packed once each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from .common import as_bytes, column, released, written
from .tokens import _tokenizer

#: Signs that end many words.
ENDS = ".,;:!?"
#: Words in each of the two generations that a worker keeps the ids of.
CACHE = 400_000

#: New words of letters that go through the library as one text.
TOGETHER = 2000
#: Characters of texts whose new words are encoded together.
GROUP = 1 << 22

#: In texts of these characters only, canonical composition changes nothing,
#: lower-casing is character by character, and ``str.split`` ends words where
#: the vocabulary does.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ɏ‐-‧€]*")


class WordIds:
    """Little-endian 32-bit ids of texts, for a vocabulary that lower-cases,
    drops white space and never joins what stands on its two sides."""

    def __init__(self, path: str, special: tuple[str, ...] = ("<|startoftext|>", "<|endoftext|>")):
        self.tok, self.special, self.known, self.older = _tokenizer(path), special, {}, {}
        # lower-cased letters are one pre-token that normalising leaves alone; its last token says so
        self.letters = Tokenizer(self.tok.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, k in self.tok.get_vocab().items():
            self.ends_word[k] = token.endswith("</w>")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, learning new words of about GROUP characters of texts at a time."""
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and held < GROUP:
                held += len(texts[j])
                j += 1
            plain = [_PLAIN.fullmatch(t) is not None and not any(x in t for x in self.special) for t in texts[i:j]]
            cut = pc.ascii_split_whitespace(pa.array([t.lower() if p else "" for t, p in zip(texts[i:j], plain)], pa.string()))
            words = cut.flatten().dictionary_encode()
            distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # with the empty one where white space begins or ends a text
            self.learn(set(filter(None, distinct)))
            known = self.known
            data = pa.array([known[x] if x else b"" for x in distinct], pa.large_binary()).take(words.indices)
            ends = np.frombuffer(data.buffers()[1], dtype=np.int64, count=len(data) + 1)[cut.offsets.to_numpy()].tolist()
            ids = data.buffers()[2].to_pybytes() if len(data) else b""
            for t, p, a, b in zip(texts[i:j], plain, ends, ends[1:]):
                if p:
                    yield ids[a:b]
                else:
                    yield array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes()
            i = j

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known, self.older = {}, self.known
            new = words
        known, older = self.known, self.older
        if older:
            again = new.intersection(older)
            known.update((w, older[w]) for w in again)
            new = new.difference(again)
        # letters and one sign are two pre-tokens
        ends = [w for w in new if w[-1] in ENDS and w[:-1].isalpha()]
        new = new.difference(ends).union([w[:-1] for w in ends], ENDS if ends else ()).difference(known)
        letters = [w for w in new if w.isalpha()]
        for i in range(0, len(letters), TOGETHER):
            some = letters[i : i + TOGETHER]
            ids = np.array(self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()]
            known.update((w, data[a:b]) for w, a, b in zip(some, cuts, cuts[1:]))
        others = list(new.difference(letters))
        for w, x in zip(others, self.tok.encode_batch_fast(others, add_special_tokens=False)):
            known[w] = array("I", x.ids).tobytes()
        for w in ends:
            known[w] = known[w[:-1]] + known[w[-1]]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordIds:
    """The one encoder of a worker, however many tasks it runs."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, length: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row."""
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = [t.decode() for t in as_bytes(batch)]
            for doc, data in zip(column(batch, "doc_id").to_pylist(), ids.encode(texts)):
                data += tail
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    for x, y in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        x.append(y)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        released()

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return cols.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    count = np.zeros(room + 1, dtype=np.int64)
    used = 0
    for k, size in enumerate(lengths.tolist()):
        # change of the sum when a bin of gap g gets the item and then has gap g - size; closed bins don't count
        after = 2 * count[: room + 1 - size] + 1
        after[0] = 0
        gain = after[:-1] - 2 * count[size:room] + 1
        gain[count[size:room] == 0] = np.iinfo(np.int64).max
        best = int(gain.argmin()) if len(gain) else -1
        if best >= 0 and gain[best] <= after[-1]:
            gap = size + best
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, used = room, used, used + 1
        bins[k], offsets[k] = b, room - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def _packed(blocks: DataFrame, shards: int, length: int) -> DataFrame:
    """blocks: block long, length long -> block, sequence, offset."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "block"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length)
        first = rows["block"].to_numpy()[np.unique(bins, return_index=True)[1]]
        return pd.DataFrame({"block": rows["block"].to_numpy(), "sequence": first[bins], "offset": offsets})

    dealt = blocks.select("block", "length", F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(pack, "block long, sequence long, offset long")


def pack(docs: DataFrame, path: str, length: int = 2048, end: int = 0, shard: int = 32_768, rounds: int = 2) -> DataFrame:
    """The pieces of docs with sequence_id and offset.

    A sequence is named by the block that opened it, so names need no count
    over all shards. Each further round takes the sequences that are not full
    yet as blocks and deals them anew.
    """
    rows = written(pieces(docs, path, length, end).withColumn("block", F.monotonically_increasing_id()), "pieces")
    place = None
    blocks = rows.filter(F.col("length") < length).select("block", "length")
    n = blocks.count()
    for k in range(rounds):
        placed = written(_packed(blocks, max(1, -(-n // shard)), length), "packed")
        if place is None:
            place = placed
        else:
            moved = placed.select(F.col("block").alias("sequence"), F.col("sequence").alias("to"), F.col("offset").alias("by"))
            place = place.join(moved, "sequence", "left").select(
                "block", F.coalesce("to", "sequence").alias("sequence"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
            )
        if k + 1 < rounds:
            sizes = placed.join(blocks, "block").groupBy("sequence").agg(F.sum("length").alias("length"))
            blocks = written(sizes.filter(F.col("length") < length).select(F.col("sequence").alias("block"), "length"), "open")
            if (left := blocks.count()) in (0, n):
                break
            n = left
    out = rows.join(place, "block", "left")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence", "block").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )
