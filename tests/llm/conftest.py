"""Small tables with every odd case that the operators define."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [sentence(rng, rng.randint(60, 160), words) for _ in range(12)]
    passage = sentence(rng, 70, words)
    texts = [None, "", " \t\n", "one", "Two words", "same text here", "same text here", "a b\x1cc d\x0be", "é ß İ ÉCOLE ﬁ ½ ² x'll I'M \U0001d4b3", "<|endoftext|> in <|startoftext|>a text<|endoftext|>"]
    texts += base
    texts += [base[0], base[0], base[1].upper(), base[2] + " " + rng.choice(words)]
    texts += [b + "\n" + passage for b in base[:3]] + [passage + " " + base[5], passage]
    texts += ["line one of the page\nline two of the page\n\nline one of the page\n" + base[3], "LINE  one of the page\nnothing else here at all"]
    texts += [" ".join(words) * 12, "=" * 700 + " " + "ab" * 300, "x" * 5000, "spam spam spam spam spam spam spam spam spam spam spam spam"]
    edited = base[4].split()
    edited[10] = "changed"
    texts += [" ".join(edited)]
    rows = [(3 * k + 1, t, "en" if k % 3 else None, f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Distinct ids; every kind of text."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def awkward(spark, odd):
    """The same with null ids, repeated rows and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    more = odd.limit(6).withColumn("doc_id", F.lit(None).cast("long"))
    out = odd.unionByName(more).unionByName(odd.filter("doc_id < 40"))
    return out.withColumns({c: F.lit("extra") for c in ("rid", "fp", "key", "id", "line", "piece", "row", "trusted", "gram", "h1", "starts", "shard", "word", "part", "score", "kept")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
