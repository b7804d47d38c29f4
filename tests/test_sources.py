

from rankloom.sources import tables


def test_rankings_round_trip(spark):
    df = spark.createDataFrame([("q", "a b a", None), ("r", "", "c")], "query_key string, x string, y string")
    long = tables.parse_rankings(df, ["x", "y"])
    assert sorted(map(tuple, long.collect())) == [("q", "x", "a", 1), ("q", "x", "a", 3), ("q", "x", "b", 2), ("r", "y", "c", 1)]
    assert tables.serialize_rankings(long.filter("channel = 'x'")).first()["answer"] == "a b a"


def test_answer_check(spark):
    corpus = spark.createDataFrame([("a",), ("b",)], "item_id string")
    answers = spark.createDataFrame([("q1", "a b"), ("q2", "a a"), ("q3", "a x"), ("q4", ""), ("q5", "a")], "query_key string, answer string")
    got = {r["query_key"]: r["ok"] for r in tables.answer_check(answers, corpus, exactly=None).collect()}
    assert got == {"q1": True, "q2": False, "q3": False, "q4": False, "q5": True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "a b")], "query_id string, answer string")
    tables.write_answers(df, str(tmp_path / "answers"))
    assert spark.read.csv(str(tmp_path / "answers"), header=True).first()["answer"] == "a b"
    tables.write_report({"x": 1}, str(tmp_path / "r.json"))
    assert tables.read_report(str(tmp_path / "r.json")) == {"x": 1}
    assert len(tables.file_digest(str(tmp_path / "r.json"))) == 64


def test_stream_of_queries(spark, tmp_path):
    from rankloom.streaming import clicks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "query_key long, search_query string")
    df.write.parquet(str(tmp_path / "in"))
    stream = clicks.event_stream(spark, str(tmp_path / "in"), df.schema)
    run = clicks.answer_stream(stream, lambda q: q.withColumnRenamed("search_query", "answer"), str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windowed_counts(spark, tmp_path):
    from rankloom.streaming import clicks

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:20:00', 'a' union all select timestamp'2024-01-01 05:00:00', 'b'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = clicks.windowed_counts(clicks.event_stream(spark, str(tmp_path / "in"), rows.schema), "ts", "k")
    q = stream.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["k"], r["n"]) for r in spark.table("win").collect()] == [("a", 2)]



def test_profile_of_empty_table(spark):
    from rankloom.operators import profile

    df = spark.createDataFrame([], "a int, b string")
    assert {r["n_rows"] for r in profile.column_profile(df).collect()} == {0}
    assert profile.repeated_rows(df, ["a"]).first()["is_unique"]
