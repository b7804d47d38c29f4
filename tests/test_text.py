from pyspark.sql import functions as F

from rankloom.functions import text as T


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_clean_folds_lower_yo_only_and_all_white_space(spark):
    assert values(spark, ["Ёлка ёж", " a \tb ", None, ""], T.clean("x")) == [("ёлка еж",), ("a b",), ("",), ("",)]


def test_tokens_keep_compounds(spark):
    out = values(spark, ["it's a well-known x² a--b", "-a-", "don't'"], T.tokenize("x"))
    assert out == [(["it's", "a", "well-known", "x²", "a", "b"],), (["a"],), (["don't"],)]


def test_min_rating(spark):
    rows = ["Рейтинг пользователя 4 звезды и выше", "", "рейтинг 4,5", "рейтинг 9", None]
    assert [r[0] for r in values(spark, rows, T.min_rating("x"))] == [4.0, None, 4.5, None, None]


def test_script(spark):
    rows = ["ремонт iphone", "ремонт айфона", "iphone repair", "1", "a", None]
    assert [r[0] for r in values(spark, rows, T.dominant_script("x"))] == ["mixed", "cyrillic", "latin", "other", "other", "other"]


def test_raw_kind(spark):
    rows = ["X Вид услуги Ремонт Тип услуги Y", "Вид услуги Маникюр", "нет", "Вид услуги "]
    assert [r[0] for r in values(spark, rows, T.raw_kind("x"))] == ["Ремонт", "Маникюр", None, None]


def windows(params, description, title, size=140, step=110, most=4):
    content = params.split() + ["описание"] + description.split()
    return [f"passage: {title}. " + " ".join(content[i : i + size]) for i in range(0, len(content), step)][:most]


def test_passages_match_plain_windows(spark):
    rows = [("t", "p q", " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 107, 110, 137, 140, 300, 900)]
    df = spark.createDataFrame(rows, "title string, params string, d string")
    got = [r[0] for r in df.select(T.passages("title", "params", "d")).collect()]
    assert got == [windows(p, d, t) for t, p, d in rows]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(0,), (1,), (99,), (100,), (10000,)], "n int")
    got = [r[0] for r in df.select(T.cut("n", [0, 99, 499, 1999, 9999], list("abcdef"))).collect()]
    assert got == ["a", "b", "b", "c", "f"]


def test_query_id_matches_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([("q", 3, None)], "a string, b int, c string")
    want = hashlib.sha1("\x1f".join(["q", "3", "None"]).encode()).hexdigest()[:16]
    assert df.select(T.query_id("a", "b", "c")).first()[0] == want


def test_char_ngrams(spark):
    assert values(spark, ["ab"], T.char_ngrams("x"))[0][0] == [" ab", "ab ", " ab "]


def test_overlap_and_contains(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    got = [tuple(r) for r in df.select(*T.overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [(1, 0.5, 1 / 3), (0, 0.0, 0.0)]
    df = spark.createDataFrame([("", "abc"), ("b", "abc"), ("x", "abc")], "q string, t string")
    assert [r[0] for r in df.select(T.contains_text(F.col("q"), F.col("t"))).collect()] == [0, 1, 0]


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(T.dot("a", "b")).first()[0] == 11.0
