"""Plain versions of what the queries return, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from rankloom.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def simhash_groups(rows, radius=3):
    """rows: (doc_id, text). Returns sorted (doc_id, fingerprint, component)."""
    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    arr = np.array(distinct, dtype=np.uint64)
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = find(f), find(distinct[j])
            root[max(a, b)] = min(a, b)
    first = defaultdict(list)
    for (d, _), f in zip(rows, fps):
        if d is not None:
            first[find(f)].append(d)
    return [(d, f"{f:016x}", min(first[find(f)], default=None)) for (d, _), f in zip(rows, fps)]


def base_rules(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup, seen = (text or "").split("\n"), 0, set()
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def substring_dedup(rows, window=50):
    """rows: (doc_id, text). Returns (doc_id, n_words, n_removed, kept_sha256)."""
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def pieces(rows, tokenizer, length=2048, end=0):
    out = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], dtype="<u4").tobytes()
            out.append((d, k, at, len(part) // 4, zlib.crc32(part)))
    return out


def edited(rows):
    """rows: (doc_id, text), distinct ids. Returns doc_id -> (n_chars, edited sha256)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        n = len(t)
        e = t[: n - n // 2] + u[: n // 2]
        out[d] = (n, hashlib.sha256(e.encode()).hexdigest())
    return out


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def majority(items, seed=0):
    """64-bit majority of the XXH64 of each item."""
    ones = [0] * 64
    for x in items:
        h = xxhash.xxh64_intdigest(x, seed)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(items))


def grouped(keys, linked):
    """Components of keys under linked(a, b), which is asked for every pair: key -> smallest key."""
    keys = sorted(keys)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def normal(line):
    return b" ".join(line.lower().encode().split()).decode()


def similar_lines(texts, similarity=0.8):
    """Every pair of distinct normalised lines whose edit similarity is that or more, and nothing else asked."""
    norm = sorted({normal(x) for t in texts for x in (t or "").split("\n")} - {""}, key=len)
    chars = {c: k for k, c in enumerate(sorted(set("".join(norm))))}
    counts = np.zeros((len(norm), len(chars)), dtype=np.int32)
    for i, x in enumerate(norm):
        for c in x:
            counts[i, chars[c]] += 1
    sizes, out = counts.sum(axis=1), []
    for i, a in enumerate(norm):
        most = int((1 - similarity) * len(a) + 1e-9)
        for j in np.flatnonzero(sizes[:i] >= len(a) - most):
            # an edit changes a character's count by one in each direction at most
            change = counts[i] - counts[j]
            if max(change[change > 0].sum(), -change[change < 0].sum()) <= most and lines.edit_distance(a, norm[j], most) <= most:
                out.append((norm[j], a))
    return out


def line_dedup(rows, linked):
    """rows: (doc_id, text), distinct ids; linked: pairs of normalised lines. doc_id -> text."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    seen, out = set(), {}
    for d, t in sorted(rows):
        kept = []
        for x in (t or "").split("\n"):
            n = normal(x)
            if not n or find(n) not in seen:
                kept.append(x)
            if n:
                seen.add(find(n))
        out[d] = "\n".join(kept)
    return out


def near_duplicates(rows, similarity=0.8, shingle=5):
    """rows: (doc_id, text), distinct ids. The ids that stay: every pair is compared."""
    low = {d: (t or "").encode().lower().split() for d, t in rows}
    sets = {d: {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for d, w in low.items()}
    texts = dict(rows)

    def linked(a, b):
        if (texts[a] or "") == (texts[b] or ""):
            return True
        x, y = sets[a], sets[b]
        return x == y if not x or not y else len(x & y) >= similarity * len(x | y)

    group = grouped(low, linked)
    return {d for d in low if group[d] == d}
