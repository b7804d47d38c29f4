"""Text functions as Column expressions; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with hyphens or apostrophes inside; Unicode letters, digits, underscore.
TOKEN = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
SPACE = r"(?U)\s+"
RATING = r"рейтинг[^\d]{0,20}([1-5](?:[.,]\d+)?)"
CYRILLIC, LATIN = "[А-Яа-яЁё]", "[A-Za-z]"
#: Closed-vocabulary key and the keys that may follow its value (fixed values).
KIND_KEY = "Вид услуги "
KIND_ENDS = ("Тип услуги", "Онлайн-запись", "Кто оказывает", "Место оказания", "Услуга ")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean(c: Column | str) -> Column:
    """Lower case after folding lower-case ё to е, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(folded(c), SPACE, " "))


def folded(c: Column | str) -> Column:
    """Lower case after folding lower-case ё to е; null is empty."""
    return F.lower(F.replace(_text(c), F.lit("ё"), F.lit("е")))


def tokenize(c: Column | str) -> Column:
    # white space ends a token however much of it there is, so it isn't collapsed first
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokenize(c))


def joined(*parts: Column | str) -> Column:
    """Clean parts with single spaces between, trimmed; nulls are empty."""
    return F.trim(F.concat_ws(" ", *[clean(p) for p in parts]))


def query_text(query: Column | str, filters: Column | str) -> Column:
    """The sparse channel's query, whose literal prefix is a token too."""
    return F.trim(F.concat(F.lit("query: "), clean(query), F.lit(" "), clean(filters)))


def dense_query_text(query: Column | str, filters: Column | str) -> Column:
    return F.trim(F.concat(clean(query), F.lit(" "), clean(filters)))


def item_text(title: Column | str, params: Column | str, description: Column | str, title_times: int = 3) -> Column:
    return joined(*[title] * title_times, params, description)


def passages(title, params, description, size: int = 140, overlap: int = 30, most: int = 4, prefix: str = "passage: ", marker: str = "описание") -> Column:
    """Array of passage texts: windows of tokens with a step of size - overlap, each after the clean title."""
    content = F.concat(tokenize(params), F.array(F.lit(marker)), tokenize(description))
    starts = F.slice(F.sequence(F.lit(0), F.size(content) - 1, F.lit(size - overlap)), 1, most)
    head = F.concat(F.lit(prefix), clean(title), F.lit(". "))
    return F.transform(starts, lambda s: F.concat(head, F.array_join(F.slice(content, s + 1, size), " ")))


def short_view(title: Column | str, params: Column | str) -> Column:
    """An item's title and parameters only, clean."""
    return F.concat(clean(title), F.lit(". "), clean(params))


def dominant_script(c: Column | str, share: float = 0.6) -> Column:
    cyrillic, latin = (F.regexp_count(_text(c), F.lit(p)) for p in (CYRILLIC, LATIN))
    total = cyrillic + latin
    return (
        F.when(total < 2, "other")
        .when(cyrillic / F.greatest(total, F.lit(1)) >= share, "cyrillic")
        .when(latin / F.greatest(total, F.lit(1)) >= share, "latin")
        .otherwise("mixed")
    )


def item_script(title: Column | str, description: Column | str, chars: int = 1000) -> Column:
    return dominant_script(F.concat(_text(title), F.lit(" "), F.substring(_text(description), 1, chars)))


def min_rating(c: Column | str) -> Column:
    """The least rating that a filter text asks for, or null."""
    found = F.regexp_extract(F.lower(_text(c)), RATING, 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def raw_kind(c: Column | str) -> Column:
    """Text after the kind key up to the next key, or null."""
    text = _text(c)
    at = F.locate(KIND_KEY, text)
    rest = F.substring(text, at + len(KIND_KEY), F.length(text))
    ends = [F.when(F.locate(k, rest) > 0, F.locate(k, rest) - 1) for k in KIND_ENDS]
    cut = F.coalesce(F.least(*ends), F.length(rest))
    return F.when(at > 0, F.nullif(F.trim(F.substring(rest, F.lit(1), cut)), F.lit("")))


def query_id(*fields: Column | str) -> Column:
    """First 16 hex digits of SHA-1 over the fields joined by \\x1f; a null field reads ``None``."""
    parts = [F.coalesce((F.col(f) if isinstance(f, str) else f).cast("string"), F.lit("None")) for f in fields]
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def collision_id(*fields: Column | str) -> Column:
    """A 63-bit id whose equality stands for that of the fields."""
    return F.xxhash64(*fields).bitwiseAND(F.lit(2**63 - 1))


def cut(c: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals; the last label is open above."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1]) if len(labels) > len(edges) else out


def char_ngrams(c: Column | str, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word padded with a space on both sides; a word
    shorter than n gives itself once and no longer n-grams."""
    words = F.filter(F.split(clean(c), " "), lambda w: w != "")

    def of(word):
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n <= F.length(padded)) | (n == low))
        return F.flatten(
            F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substring(padded, i, n)))
        )

    return F.flatten(F.transform(words, of))


def contains_text(needle: Column, hay: Column) -> Column:
    return ((F.length(needle) > 0) & F.contains(hay, needle)).cast("int")


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Size of the intersection of two distinct arrays, its share of a, and Jaccard."""
    n = F.size(F.array_intersect(a, b))
    return n, n / F.greatest(F.size(a), F.lit(1)), n / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def positive(c: Column | str) -> Column:
    return F.greatest(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, summed from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
