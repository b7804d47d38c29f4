"""Operators against plain versions, on odd rows and on the driver's small table."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import bpe, editprint, graph, kneser_ney, langid, lines, packing, rules, simhash, substrings, tokens
from rankloom.llm.queries import pattern, vocabulary

from . import brute
from .conftest import pairs

JSON, WORDS, RANKS = (vocabulary(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def ordered(rs):
    return sorted(map(tuple, rs), key=lambda r: tuple((x is None, str(x)) for x in r))


def both(spark, odd, sf_dir):
    return [odd, spark.read.parquet(f"{sf_dir}/documents.parquet")]


# --- near-duplicates ----------------------------------------------------------


def test_simhash_groups(spark, odd, awkward, sf_dir):
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f")
    for df in [*both(spark, odd, sf_dir), awkward]:
        got = simhash.simhash_groups(df, shingle=3).select("doc_id", hexed, "component_id")
        assert rows(got, "doc_id", "f", "component_id") == ordered(brute.simhash_groups(pairs(df)))


def test_covering_masks_find_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            change = sum(1 << int(i) for i in rng.choice(64, rng.integers(0, radius + 1), replace=False))
            assert any(not m & change for m in masks)


@pytest.mark.parametrize("bucket", [4, 64])
def test_bucket_links_split_large_buckets_without_losing_links(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62)
    fps = sorted({int(base) ^ sum(1 << int(i) for i in rng.choice(60, rng.integers(0, 4), replace=False)) for _ in range(150)})
    df = spark.createDataFrame([(1, f, f) for f in fps] + [(2, 5, 5), (2, 2**40 + 5, 2**40 + 5), (3, 9, 9)], "key long, id long, fp long")
    found = graph.components(graph.bucket_links(df, 3, bucket).select("a", "b"))
    got = {r["node"]: r["root"] for r in found.collect()}
    root = graph.hamming_components(np.array(fps, dtype=np.uint64), 3)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(fps[i])
    want = {f: min(g) for g in want.values() for f in g if f != min(g)}
    assert {k: v for k, v in got.items() if k in want} == want and got[2**40 + 5] == 5


@pytest.mark.parametrize("block", [50, 5000])
def test_group_links_connect_what_pairs_do(spark, block):
    """Numbers of one group are the same if they differ by one at most; large groups go through parts, representatives and blocks."""
    rng = np.random.default_rng(9)
    values = {i + 1: int(v) for i, v in enumerate(rng.integers(0, 1200, 400))}
    groups = [(7, i, None) for i in values] + [(8, i, 0) for i in range(1, 101)] + [(9, 1, 5), (9, 2, 5)]
    df, members = spark.createDataFrame(groups, "g long, id long, fp long"), spark.createDataFrame(list(values.items()), "id long, payload long")
    found = graph.components(graph.group_links(df, members, lambda a, b: abs(a - b) <= 1, block=block))
    group = brute.grouped(values, lambda a, b: abs(values[a] - values[b]) <= 1)
    assert {r["node"]: r["root"] for r in found.collect()} == {i: g for i, g in group.items() if i != g}


@pytest.mark.parametrize("whole", [0, 100])
def test_long_runs_that_share_a_member_meet_only_inside(spark, whole):
    """Twelve runs of 81 members, each sharing its last with the next; up to ``whole`` members of unlike runs aren't compared."""
    rng = np.random.default_rng(10)
    values = {i: int(v) for i, v in enumerate(rng.integers(0, 400, 12 * 80 + 1))}
    runs = {k: list(range(80 * k, 80 * k + 81)) for k in range(12)}
    rows = spark.createDataFrame([(k, i, 0, 10) for k, m in runs.items() for i in m], "key long, id long, fp long, size long")
    payloads = spark.createDataFrame([(i, [v, i]) for i, v in values.items()], "id long, payload array<long>")

    def same(a, b):
        low, high = sorted((a[1], b[1]))
        assert not whole or high <= 80 * (low // 80) + 80, "members of unlike runs are compared"
        return abs(a[0] - b[0]) <= 1

    links = graph.banded_links(rows, lambda ids: payloads.join(ids, "id"), same, lambda x: x, None, 26, 0.8, whole=whole)
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    if whole:
        group = brute.grouped(values, lambda a, b: abs(values[a] - values[b]) <= 1 and any(a in m and b in m for m in runs.values()))
    else:
        group = brute.grouped(values, lambda a, b: abs(values[a] - values[b]) <= 1)
    assert found == {i: g for i, g in group.items() if i != g}


def test_wide_runs_give_every_near_pair_and_move_no_payload_for_a_key(spark, monkeypatch):
    """Runs of one key that all share members: pairs by their bits, the longest run as a group; links are those of all near pairs."""
    rng = np.random.default_rng(13)
    prints = {i: int(v) for i, v in enumerate(rng.integers(0, 1 << 12, 700))}
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
    runs = {k: [i for i in prints if i % 7 in (0, k)] for k in range(1, 7)} | {9: list(range(0, 350))}
    rows = spark.createDataFrame([(k, i, prints[i], 10) for k, m in runs.items() for i in m], "key long, id long, fp long, size long")
    payloads = spark.createDataFrame(list(prints.items()), "id long, payload long")
    moved = []
    links_of = graph.group_links
    monkeypatch.setattr(graph, "group_links", lambda groups, *a, **k: moved.append(groups.count()) or links_of(groups, *a, **k))
    links = graph.banded_links(rows, lambda ids: payloads.join(ids, "id"), lambda a, b: (a ^ b) % 3 != 1, lambda x: x, lambda m: lambda i, x: x, 2, 0.8, wide=300)
    found = {r["node"]: r["root"] for r in graph.components(links).collect()}
    group = brute.grouped(prints, lambda a, b: near(a, b) and (prints[a] ^ prints[b]) % 3 != 1 and any(a in m and b in m for m in runs.values()))
    assert found == {i: g for i, g in group.items() if i != g}
    assert moved == [350]


def test_rows_are_dealt_in_blocks_and_keys_of_one_row_go():
    """What comes out of the blocks of two tasks are the runs of two members and more, sorted, each member once."""
    rng = np.random.default_rng(4)
    rows = np.column_stack([rng.integers(-400, 400, 900), rng.integers(0, 60, 900)])
    batch = lambda x: graph.pa.RecordBatch.from_arrays([graph.pa.array(c) for c in (x[:, 0] << 40, x[:, 1], x[:, 1] * 3, x[:, 1] + 7)], names=["key", "id", "fp", "size"])
    blocks = [r for some in (rows[:500], rows[500:]) for x in graph.packed(iter([batch(some)]), 16) for r in x.to_pylist()]
    assert len(blocks) <= 32
    blocks = graph.pa.RecordBatch.from_pylist(sorted(blocks, key=lambda r: r["part"]))
    got = [(r["key"] >> 40, r["id"], r["fp"], r["size"]) for x in graph.unpacked(iter([blocks.slice(0, 7), blocks.slice(7)])) for r in x.to_pylist()]
    want = set(map(tuple, rows.tolist()))
    runs = {k: sorted(i for q, i in want if q == k) for k, _ in want}
    assert sorted(got) == sorted((k, i, 3 * i, i + 7) for k, m in runs.items() if len(m) > 1 for i in m)
    assert [i for k, i, *_ in got if k == got[0][0]] == runs[got[0][0]]


def test_far_pairs_are_told_by_a_bound_that_loses_none():
    rng = random.Random(6)
    pairs = []
    for k in range(300):
        x = [rng.choice("etaoin shrdl") for _ in range(rng.randint(32, 300))]
        y = x[:] if k % 3 else [rng.choice("etaoin shrdl") for _ in x]
        for _ in range(rng.randint(0, len(x) // 3)):
            at = rng.randrange(len(y))
            y[at : at + rng.randint(0, 2)] = rng.choice(["", "é", "to"])
            y = y or ["a"]
        pairs.append(("".join(x), "".join(y)))
    members = [lines.with_bigrams(t) for p in pairs for t in p]
    at = np.arange(len(pairs))
    fit = lines.may_be_similar(members, 2 * at, 2 * at + 1, 0.8)
    like = np.array([lines.similar(members[2 * k], members[2 * k + 1], 0.8) for k in at])
    assert like.sum() > 30 and not (like & ~fit).any() and (fit & ~like).sum() < 0.2 * (~like).sum()


@pytest.mark.parametrize("apart", [2, 64])
def test_a_group_judged_in_turn_is_connected_as_by_all_pairs(apart):
    rng = np.random.default_rng(21)
    values, bits = rng.integers(0, 900, 700), rng.integers(0, 1 << 10, 700)
    like = lambda a, b: abs(int(a) - int(b)) <= 1
    verify = graph._verifier(like, lambda x: x, None, apart, lambda m, i, j: np.abs(np.array(m)[i] - np.array(m)[j]) <= 3)
    rows = [{"id": i, "label": i, "fp": None if i % 50 == 0 else int(bits[i]), "payload": int(v)} for i, v in enumerate(values)]
    out = next(verify(iter([graph.pa.RecordBatch.from_pylist([{"m": rows}])]))).to_pylist()
    near = lambda a, b: a % 50 == 0 or b % 50 == 0 or (int(bits[a]) ^ int(bits[b])).bit_count() <= apart
    group = brute.grouped(range(700), lambda a, b: like(values[a], values[b]) and near(a, b))
    assert brute.grouped(range(700), lambda a, b, links={frozenset(r.values()) for r in out}: frozenset((a, b)) in links) == group
    assert len(out) == 700 - len(set(group.values()))


def test_pairs_that_others_connect_are_not_judged():
    """Of forty copies only as many pairs are judged as connect them; of unlike members all are."""
    for alike in (True, False):
        up, asked = list(range(40)), []

        def judged(i, j, alike=alike, up=up, asked=asked):
            asked.extend(zip(i.tolist(), j.tolist()))
            for x, y in zip(i.tolist(), j.tolist()) if alike else ():
                up[:] = [up[x] if u == up[y] else u for u in up]
            return len(i) * alike

        graph.in_rounds(*np.array([(i, j) for i in range(40) for j in range(i)]).T, lambda x, up=up: up[x], judged)
        assert len(asked) == len(set(asked)) == (39 if alike else 780)


def test_bands_are_dealt_in_turns(spark, odd, monkeypatch):
    """The keys of a turn are a part of all keys, and each key is in one turn."""
    from rankloom.llm.common import keyed

    dealt = []
    links_of = lines.banded_links
    monkeypatch.setattr(lines, "banded_links", lambda rows, *a, **k: dealt.extend(rows) or links_of(rows, *a, **k))
    table = lines.line_groups(keyed(odd))[0]
    size = lambda df: sum(len(r["data"]) for r in df.select("data").collect())
    whole = size(lines.band_rows(table))
    assert whole and [size(x) for x in dealt] == [whole // 2] * 2


def test_written_tables_have_no_checksum_files(spark):
    """Each of these is a process started beside the executor's."""
    from pathlib import Path

    from rankloom.llm import common

    table = common.written(spark.range(100).repartition(3), "raw")
    folder = Path(common.CREATED[-1].removeprefix("file://"))
    assert table.count() == 100 and list(folder.glob("*.parquet")) and not list(folder.glob(".*.crc"))


def test_components_of_a_long_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000}
    assert graph.components(chain.limit(0)).count() == 0


def test_near_duplicates_keep_one_of_each_group(odd, awkward, empty):
    got = simhash.near_duplicates(odd)
    keep = {r["doc_id"] for r in got.filter("keep").collect()}
    texts = dict(pairs(odd))
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t or "", []).append(d)
    for ids in by_text.values():
        assert len(keep & set(ids)) <= 1
    groups = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert all(groups[d] in keep for d in texts)

    def shingles(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for d, c in groups.items():  # a dropped document is near some other of its group
        if d not in keep:
            others = [o for o, x in groups.items() if x == c and o != d]
            a = shingles(texts[d])
            assert any(len(a & (b := shingles(texts[o]))) >= 0.8 * len(a | b) for o in others)
    assert simhash.near_duplicates(awkward).count() == awkward.select("doc_id", "text").distinct().count()
    assert simhash.near_duplicates(empty).count() == 0


# --- lines -----------------------------------------------------------------------


def test_edit_distance_matches_the_plain_recursion():
    rng = np.random.default_rng(2)
    for _ in range(800):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 14))) for _ in range(2))
        d = brute.edit_distance(a, b)
        for most in (0, 2, 20):
            assert lines.edit_distance(a, b, most) == (d if d <= most else most + 1)
        assert lines.similar(lines.with_bigrams(a), lines.with_bigrams(b), 0.8) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)


def removed(texts, kept):
    """(doc_id, normalised line, how often) of all that is in texts and not in kept."""
    from collections import Counter

    out = Counter()
    for d, t in texts.items():
        for sign, x in ((1, t or ""), (-1, kept[d])):
            for line in x.split("\n"):
                out[d, brute.normal(line)] += sign
    return {(d, x, k) for (d, x), n in out.items() if x for k in range(n)}


def test_lines_against_all_pairs(spark, odd, sf_dir):
    """At the defaults, against every pair of lines of that edit similarity: nothing else goes, and nearly all of it does."""
    for df in both(spark, odd, sf_dir):
        texts = dict(pairs(df))
        got = removed(texts, {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()})
        want = removed(texts, brute.line_dedup(texts.items(), brute.similar_lines(texts.values())))
        assert got <= want
        for least, most in ((1, 40), (40, 120), (120, 1 << 40)):
            there = {x for x in want if least <= len(x[1]) < most}
            assert len(there & got) >= 0.9 * len(there)


def test_near_duplicates_against_all_pairs(spark, odd, sf_dir):
    for df in both(spark, odd, sf_dir):
        got = {r["doc_id"] for r in simhash.near_duplicates(df).filter("keep").collect()}
        assert got == brute.near_duplicates(pairs(df))


def test_exact_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, fuzzy_words=10**9).collect()}
    assert got == brute.line_dedup(pairs(docs), [])


def test_fuzzy_lines(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    one = " ".join(words)
    near = one.replace(words[30], words[30][:-1] + "x")
    texts = [one, near.upper(), "other line here of five\n" + near + "\nend", "end"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert [out[k]["text"] for k in range(4)] == [one, "", "other line here of five\nend", ""]
    assert [out[k]["n_removed"] for k in range(4)] == [0, 1, 1, 1]


def test_runs_of_digests_match_single_simhashes():
    import xxhash

    runs = [[xxhash.xxh64_digest(f"{k} {i}") for i in range(n)] for k, n in enumerate((1, 2, 254, 255, 256, 900))]
    got = lines.simhash_runs(np.frombuffer(b"".join(b"".join(r) for r in runs), np.uint8), np.array([len(r) for r in runs]), chunk=300)
    assert got.tolist() == [simhash.simhash(r) for r in runs]


def test_awkward_lines(awkward, empty):
    out = lines.dedup_lines(awkward, carry=["lang", "rid"])
    assert out.count() == awkward.count() and out.columns == ["doc_id", "text", "n_lines", "n_removed", "lang", "rid"]
    same = out.groupBy("doc_id").agg(F.countDistinct("text").alias("n")).filter("doc_id < 40 and n > 1")
    assert same.count() == 0
    assert lines.dedup_lines(empty).count() == 0


# --- tokens ---------------------------------------------------------------------------


def hf(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("hot", [0, 20, 1 << 19])
def test_token_counts(spark, odd, awkward, empty, sf_dir, hot):
    tok = hf(JSON)
    for df in [odd, awkward] + ([spark.read.parquet(f"{sf_dir}/documents.parquet")] if hot > 100 else []):
        want = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in pairs(df)]
        assert rows(tokens.token_counts(df, JSON, pattern(), hot), "doc_id", "n_bytes", "n_tokens") == ordered(want)
    assert tokens.token_counts(empty, JSON, pattern()).count() == 0


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_and_packing(spark, odd, awkward, empty, sf_dir, length):
    tok = hf(WORDS)
    for df in [odd, awkward] + ([spark.read.parquet(f"{sf_dir}/documents.parquet")] if length > 100 else []):
        out = packing.pack(df, WORDS, length, 0, shard=50).cache()
        assert rows(out, "doc_id", "piece", "start", "length", "ids_crc32") == ordered(brute.pieces(pairs(df), tok, length))
        places = {}
        for r in out.collect():
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for used in places.values():
            at = 0
            for offset, n in sorted(used):
                assert offset == at
                at += n
            assert at <= length
        bound = -(-sum(r["length"] for r in out.collect()) // length)
        assert len(places) <= 1.15 * bound + 1
    assert packing.pack(empty, WORDS).count() == 0


def test_a_worker_makes_one_encoder(monkeypatch):
    """It was made anew for every task, beside the one in use."""
    made = []
    monkeypatch.setattr(packing, "WordIds", made.append)
    packing.encoder.cache_clear()
    assert [packing.encoder("a vocabulary") for _ in range(3)] == [None] * 3 and made == ["a vocabulary"]
    packing.encoder.cache_clear()


def test_words_of_a_batch_are_learnt_together(monkeypatch):
    import public_tokenizers
    from rankloom.llm import common, packing

    texts = ["", " \t", " Two  words,\r\n", "été À la", "a\x0bb 日本", "x" * 300, "Two words, twice. " * 90_000, "end of the batch " * 90_000]
    assert sum(map(len, texts)) < common.BATCH_BYTES
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    learn = ids.learn
    monkeypatch.setattr(ids, "learn", lambda words: asked.append(sorted(words)) or learn(words))
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in ids.encode(texts)]
    assert got == [x.ids for x in ids.tok.encode_batch(texts, add_special_tokens=False)]
    # every distinct word once, for all texts of the batch
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) and "" not in asked[0] and {"two", "words,", "batch"} <= set(asked[0])


def test_sum_of_squares_takes_the_best_gap():
    def plain(sizes, room):
        gaps, where, out = [], [], []
        for s in sizes:
            best = None
            for b in [*range(len(gaps)), None]:
                new = list(gaps) + ([room] if b is None else [])
                k = len(gaps) if b is None else b
                if new[k] < s:
                    continue
                new[k] -= s
                counts = {}
                for g in new:
                    if g:
                        counts[g] = counts.get(g, 0) + 1
                value = sum(v * v for v in counts.values())
                if best is None or value < best[0]:
                    best = (value, k, new)
            gaps = best[2]
            out.append(best[0])
        return out, len(gaps)

    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 12, 30)
        bins, offsets = packing.sum_of_squares(sizes, 12)
        left, squares = {}, []
        for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes.tolist()):
            assert left.setdefault(b, 12) == 12 - o
            left[b] -= s
            counts = {}
            for g in left.values():
                if g:
                    counts[g] = counts.get(g, 0) + 1
            squares.append(sum(v * v for v in counts.values()))
        # ties between gaps may part the two later; the first steps agree and every step is the least
        assert squares[:3] == plain(sizes.tolist(), 12)[0][:3]


def test_byte_pair_encoding(spark, odd, awkward, empty, sf_dir):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})

    def want(d, t):
        ids = enc.encode_ordinary(t or "")
        return d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for df in [*both(spark, odd, sf_dir), awkward]:
        got = bpe.round_trip(df, RANKS, pattern())
        assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want(d, t) for d, t in pairs(df))
    assert bpe.round_trip(empty, RANKS, pattern()).count() == 0
    codec = bpe.codec(RANKS, pattern())
    for word in (b"=" * 150 + b"ab", "é→".encode() * 25, b"the" * 40):
        assert codec.contract_long([word]) == codec.contract([word])
    ids = bpe.encode(odd, RANKS, pattern())
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(ids, RANKS, pattern()).collect()}
    assert back == {d: t or "" for d, t in pairs(odd)}


def test_long_words_in_one_task(spark):
    """Many long words, and words longer than any unit, of several kinds of letters, against the library."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(13)
    pieces = ["th", "er", "on", "qu", "x", "zj", "k", "o", "ing", "ment", "st", "a"]
    many = " ".join("".join(rng.choice(pieces, 120))[:199] for _ in range(40_000))
    kinds = [pieces, list("abcdefghijklmnopqrstuvwxyz"), ["a", "b"], ["="], list("กขคงจฉชซดตถทนบปผพภมยรลวศสหอฮ"), list("春夏秋冬東南西北山川海空")]
    texts = [many] + ["".join(rng.choice(k, n)) for k in kinds for n in (41, 60, 200, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, RANKS, pattern()).collect()}
    for d, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


# --- quality -----------------------------------------------------------------------------


def test_base_rules(spark, odd, awkward, empty, sf_dir):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = odd.select("doc_id").filter("doc_id % 2 = 0")
    for df in [*both(spark, odd, sf_dir), awkward]:
        got = rules.quality(df, good)
        assert rows(got, *names) == ordered((d, *brute.base_rules(t)) for d, t in pairs(df))
        assert got.filter("base_failed and kept").count() == 0
    assert rules.quality(empty, good).count() == 0


def test_log_ratio_is_that_of_plain_counts(odd):
    bits = 8
    docs = odd.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    good = odd.select("doc_id").filter("doc_id % 2 = 0")
    got = rules.log_ratios(docs, good, bits)
    raw, fine = np.ones(1 << bits), np.ones(1 << bits)
    for d, t in pairs(odd):
        b = (t or "").encode()
        for i in range(len(b) - 3):
            h = (int.from_bytes(b[i : i + 4], "big") * 2654435769 % 2**32) >> (32 - bits)
            raw[h] += 1
            fine[h] += d % 2 == 0
    want = np.log(fine / fine.sum()) - np.log(raw / raw.sum())
    assert np.abs(got / rules.UNIT - want).max() < 1e-6


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over bytes, by the definition."""
    from collections import Counter

    order = 4
    counts = {order: Counter()}
    for t in texts:
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, context = {}, {}
    for n, c in counts.items():
        of = Counter(c.values())
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            d = (1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 1.5)
            d = tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))
        else:
            d = (0.5,) * 3
        discount[n] = d
        context[n] = {}
        for g, k in c.items():
            context[n].setdefault(g[:-1], []).append(k)

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / 256
        following = context[n].get(g[:-1])
        if following is None:
            return lower
        off = lambda k: discount[n][min(k, 3) - 1]
        k = counts[n].get(g, 0)
        seen = max(k - off(k), 0) if k else 0
        return (seen + sum(min(off(x), x) for x in following) * lower) / sum(following)

    return p


@pytest.mark.parametrize("hot", [0, 50, 1 << 19])
def test_perplexity_is_that_of_the_plain_model(odd, hot):
    good = {d for d, t in pairs(odd) if d % 2 == 0}
    p = plain_kneser_ney([(t or "").encode() for d, t in pairs(odd) if d in good])
    got = {r["doc_id"]: r for r in kneser_ney.perplexities(odd, odd.select("doc_id").filter("doc_id % 2 = 0"), hot).collect()}
    for d, t in pairs(odd):
        b = (t or "").encode()
        want = sum(np.log(p(b[i : i + 4])) for i in range(len(b) - 3))
        assert got[d]["n_grams"] == max(0, len(b) - 3)
        assert got[d]["log_sum"] / kneser_ney.UNIT == pytest.approx(want, abs=1e-3 + 1e-6 * len(b))


def test_classifier_cases(spark, awkward, empty, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    good = labels.filter("quality = 1").select("doc_id")
    out = kneser_ney.classify(docs, good).join(labels, "doc_id")
    rate = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate.get(0, 0) < 0.5
    out = kneser_ney.classify(awkward, awkward.select("doc_id"))
    assert out.count() == awkward.count()
    assert out.join(awkward.filter("text is null").select("doc_id").distinct(), "doc_id").filter("kept or perplexity is not null").count() == 0
    assert kneser_ney.classify(awkward, awkward.select("doc_id").limit(0)).filter("perplexity is not null and not kept").count() == 0
    assert kneser_ney.classify(empty, empty.select("doc_id")).count() == 0


def test_language(spark, awkward, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(docs.filter(~held).select("doc_id", "text", "lang"))
    out = langid.predict(docs, model).join(docs.filter(held).select("doc_id", "lang"), "doc_id")
    assert out.filter("lang = lang_pred").count() >= 0.97 * out.count() > 0
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, None), (2, "12 !?"), (3, ""), (4, "zqxwv thenation")], "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"
    assert langid.predict(awkward, model).count() == awkward.count()
    nothing = langid.train(empty.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(awkward, nothing).collect()} == {"und"}


def plain_languages(learn, ask):
    """learn: (lang, text); ask: texts. The definition, word by word and character by character."""
    import math
    import unicodedata
    from collections import Counter

    def words(text):
        out = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        return out.split()

    langs = sorted({g for g, t in learn if t and words(t)})
    seen = {g: Counter() for g in langs}
    for g, t in learn:
        if g in seen:
            seen[g].update(words(t))
    grams = {g: Counter() for g in langs}
    for g in langs:
        for w, n in seen[g].items():
            x = f"<{w}>"
            for k in range(1, 5):
                for i in range(len(x) - k + 1):
                    grams[g][x[i : i + k]] += n
    known, kinds = set().union(*seen.values()), set().union(*grams.values())

    def log(table, x, same):
        total = sum(n for y, n in table.items() if same(y))
        return math.log((table.get(x, 0) + 0.5) / (total + 0.5 * sum(map(same, known if table in seen.values() else kinds)) + 1))

    cache = {}

    def value(g, w):
        if (g, w) not in cache:
            if w in known:
                cache[g, w] = log(seen[g], w, lambda y: True)
            else:
                x, total = f"<{w}>", 0.0
                for end in range(2, len(x) + 1):
                    for n in range(min(4, end), 0, -1):
                        if (gram := x[end - n : end]) in kinds:
                            total += log(grams[g], gram, lambda y: len(y) == n) + (4 - n) * math.log(0.4)
                            break
                    else:
                        total += -16.0
                cache[g, w] = total / (len(x) - 1)
        return cache[g, w]

    out = []
    for t in ask:
        ws = words(t)
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        means = [sum(value(g, w) for w in ws) / len(ws) for g in langs]
        best = max(range(len(langs)), key=lambda k: means[k])
        out.append((langs[best], 1 / sum(math.exp(m - means[best]) for m in means)))
    return out


def test_language_is_that_of_the_plain_version(spark):
    learn = [("en", "the cat sat on the mat"), ("en", "nothing like the old house"), ("de", "die katze sass auf der matte"), ("de", "das alte haus"), ("fr", "le chat est ½ là ²"), (None, "unlabelled"), ("xx", "12")]
    ask = ["the old katze", "zzzz thematte", "½ 3", "² ① Ⅷ", "x² Häuser", None, "", "là-bas chat", "日本 the", "ﬁne ŒUVRE 'die'", "the die"]
    model = langid.train(spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(learn)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(ask)), "doc_id long, text string"), model).collect()}
    for k, (lang, score) in enumerate(plain_languages([x for x in learn if x[0]], ask)):
        assert got[k]["lang_pred"] == lang and got[k]["score"] == pytest.approx(score)
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" != got[4]["lang_pred"]


def test_unseen_words_back_off_to_shorter_grams():
    m = langid.LanguageModel({"a": {"known": 5}, "b": {}}, {"a": {"x": 9, "xy": 4}, "b": {"x": 1, "z": 7}}, 2)
    x, xy = m.gram_logs[m.grams["x"]], m.gram_logs[m.grams["xy"]]
    want = (x + langid.PENALTY + xy + m.floor) / 3  # "<x" falls to "x", "xy" is known, "y>" is nowhere
    assert m.unseen("xy") == pytest.approx(want)


# --- fingerprints -------------------------------------------------------------------------------


def plain_walk(text):
    """Character by character: steps, and the code point written at each."""
    one, s, at = editprint._stay(), 0, []
    for x in editprint.code_points(text):
        n = int(one[int(editprint.classes(np.array([x]))[0]), s % editprint.PHASES])
        at += [int(x)] * n
        s += n
    return s, at


def test_walk_by_triples_is_the_walk_by_characters():
    for text in ("", "a", "ab", "abc", "abcd", "héllo \U0001d4b3 world " * 9, "x" * 800):
        w, (steps, at) = editprint.Walk(editprint.code_points(text)), plain_walk(text)
        assert w.steps == steps
        chosen = [int(s) for s in editprint.sampled_steps(steps.bit_length()) if s < steps] if steps else []
        want = [int(editprint._mix(np.array([at[s]], dtype=np.uint64) << np.uint64(32) ^ np.uint64(s))[0] >> np.uint64(63)) for s in chosen]
        assert w.bits().astype(int).tolist() == want
        if len(text) > 9:
            same = len(text) // 2
            edited = editprint.code_points(text[:same] + "other")
            a, b = editprint.Walk(edited, w, same), editprint.Walk(edited)
            assert a.steps == b.steps and (a.at == b.at).all()


def test_compared(spark, odd, awkward, empty, sf_dir):
    for df in both(spark, odd, sf_dir):
        for part in (5, 4000):
            got = editprint.compared(df, part).cache()
            assert rows(got, "doc_id", "n_chars", "edited_sha256") == ordered((d, *v) for d, v in brute.edited(pairs(df)).items())
            assert got.filter("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    long = got.filter("n_chars > 200")
    row = long.agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.min("near_edited").alias("least")).first()
    assert row["e"] > 0.45 and row["n"] < 0.15 and row["least"] > 0.2
    texts = {r["fingerprint"] for r in editprint.fingerprints(odd.filter("text = 'same text here'")).collect()}
    assert len(texts) == 1
    assert editprint.compared(awkward, 5).count() == awkward.count()
    assert editprint.compared(empty).count() == 0


def test_near_groups(odd, awkward, empty):
    got = {r["doc_id"]: r["component_id"] for r in editprint.near_groups(odd).join(odd.select("doc_id"), "doc_id").collect()}
    texts = dict(pairs(odd))
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t or "", set()).add(got[d])
    assert all(len(c) == 1 for c in by_text.values())
    assert editprint.near_groups(awkward).count() == awkward.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
    assert editprint.near_groups(empty).count() == 0


def test_near_groups_against_all_pairs(spark, sf_dir):
    """Nothing is linked that isn't similar, and most of what is similar is found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng, more = np.random.default_rng(6), []
    for d, t in pairs(docs):
        words = (t or "").split(" ")
        if 40 < len(words) < 400:
            for i in rng.choice(len(words), max(1, len(words) // 50), replace=False):
                words[i] = "changed"
            more.append((d + 10**6, " ".join(words)))
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = dict(pairs(df))
    got = {r["doc_id"]: r["component_id"] for r in editprint.near_groups(df).collect()}
    ready = {d: lines.with_bigrams(t or "") for d, t in texts.items()}
    ids = sorted(texts, key=lambda d: len(ready[d][0]))
    found = total = 0
    for k, a in enumerate(ids):
        may = lines.screen([ready[d] for d in ids[max(0, k - 60) : k + 1]], 0.8)(min(k, 60), np.arange(min(k, 60)))
        for j in may:
            b = ids[max(0, k - 60) + j]
            if lines.similar(ready[a], ready[b], 0.8):
                total += 1
                found += got[a] == got[b]
    assert found >= 0.8 * total > 50
    groups = {}
    for d, c in got.items():
        groups.setdefault(c, []).append(d)
    for g in groups.values():
        for d in g if len(g) > 1 else []:
            assert any(lines.similar(ready[d], ready[o], 0.8) for o in g if o != d)


# --- substrings --------------------------------------------------------------------------------------


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substrings(spark, odd, sf_dir, batches):
    for df in [odd] + ([spark.read.parquet(f"{sf_dir}/documents.parquet")] if batches < 5 else []):
        got = substrings.dedup_substrings(df, 50, batches, fanout=2)
        assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(brute.substring_dedup(pairs(df)))
        for r in got.collect():
            assert hashlib.sha256(" ".join(brute.words(r["text"])).encode()).hexdigest() == r["kept_sha256"]


def test_an_index_goes_on_after_saving(spark, odd, tmp_path):
    from rankloom.llm.common import keyed, shared_folder, written

    rows_ = keyed(odd).select("rid", "doc_id", "text").orderBy("doc_id")
    ids = sorted(d for d, _ in pairs(odd))
    parts = []
    for k in range(4):
        low, high = ids[len(ids) * k // 4], ids[min(len(ids) - 1, len(ids) * (k + 1) // 4)] + (k == 3)
        rows_.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).write.parquet(path := f"{tmp_path}/part{k}")
        parts.append(path)

    def starts(index, paths):
        return sorted((r["rid"], tuple(r["starts"])) for p in paths for r in index.add(spark.read.parquet(p), p)[1].collect())

    whole = substrings.WindowIndex(spark, 50, 2)
    want = starts(whole, parts)
    first = substrings.WindowIndex(spark, 50, 2)
    got = starts(first, parts[:2])
    assert [level for level, _ in first.runs] == [1]
    first.save(f"{tmp_path}/index")
    again = substrings.WindowIndex.load(spark, f"{tmp_path}/index")
    assert sorted(got + starts(again, parts[2:])) == want != []
    assert [level for level, _ in again.runs] == [2]


def test_substrings_of_awkward_rows(awkward, empty):
    out = substrings.dedup_substrings(awkward, 50, 2, carry=["rid"])
    assert out.count() == awkward.count() and "rid" in out.columns
    sized = awkward.select(F.coalesce("doc_id", F.lit(2**62)).alias("doc_id"), "text")
    want = sorted((n, r, s) for _, n, r, s in brute.substring_dedup(pairs(sized)))
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()) == want
    assert substrings.dedup_substrings(empty).count() == 0


def test_window_hashes_are_equal_only_for_equal_windows():
    words = [f"w{i % 7}".encode() for i in range(60)]
    h = substrings.word_hashes(words)
    a, b = substrings.window_hashes(h, 10)
    keys = {}
    for i in range(51):
        keys.setdefault(tuple(words[i : i + 10]), set()).add((int(a[i]), int(b[i])))
    assert all(len(v) == 1 for v in keys.values()) and len(set.union(*keys.values())) == len(keys)
    x = np.arange(20)[::-1] % 7
    assert substrings.sliding_least(x, 6).tolist() == [min(x[i : i + 6]) for i in range(15)]


def test_lines_with_few_edits_are_found_at_the_defaults(spark):
    """One word or character replaced, in short, ordinary and unspaced lines, without a radius in the plain version."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(4, 9))))
    near = []
    for n in (5, 10, 20, 50):
        for _ in range(25):
            w = [word() for _ in range(n)]
            v = list(w)
            v[int(rng.integers(n))] = word()
            near.append((" ".join(w), " ".join(v)))
    for n in (12, 60):  # unspaced, one character replaced
        for _ in range(25):
            x = "".join(rng.choice(list("abcdefghiklmnoprstu"), n))
            k = int(rng.integers(n))
            near.append((x, x[:k] + "z" + x[k + 1 :]))
    near = [(a, b) for a, b in near if brute.edit_distance(a, b) <= 0.2 * max(len(a), len(b))]
    docs = spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(near) for i, x in enumerate(p)], "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(docs).filter("n_removed = 1").collect()}
    assert all(d % 2 for d in gone)
    assert len(gone) >= 0.95 * len(near)


def test_near_duplicates_without_a_radius(spark):
    """Texts of a five-word Jaccard similarity of 0.8 and a little more, against all pairs."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(2, 8))))
    vocabulary, texts = [word() for _ in range(2000)], []
    for k in range(40):
        n = int(rng.integers(60, 400))
        w = list(rng.choice(vocabulary, n))
        v = list(w)
        if k % 2:  # further words at the end
            v += list(rng.choice(vocabulary, int(0.2 * n)))
        else:  # words replaced here and there
            for i in rng.choice(n, max(1, n // 50), replace=False):
                v[i] = word()
        texts += [" ".join(w), " ".join(v)]
    rows_ = list(enumerate(texts))
    got = {r["doc_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).filter("keep").collect()}
    assert got == brute.near_duplicates(rows_)


def test_walks_on_both_sides_of_a_level_share_its_bands():
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abcdefghiklmnoprstu "), 3000))
    steps = [editprint.Walk(editprint.code_points(text[:k])).steps for k in range(len(text))]
    ends = [k for k in range(100, len(text) - 1) if steps[k].bit_length() < steps[k + 1].bit_length()]
    assert len(ends) >= 3
    for k in ends:
        a, b = ({x for keys, _ in editprint.band_rows(editprint.as_text(editprint.Walk(editprint.code_points(text[:n]))), 24, 16) for x in keys} for n in (k, k + 1))
        assert len(a & b) >= 24
