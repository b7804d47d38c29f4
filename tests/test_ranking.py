import numpy as np
import pytest

from rankloom.operators import bm25, filters, joins, metrics, ranking, sampling, stats, vectors
from rankloom.operators.ltr import inside, pair_weights


def ranks(spark, lists):
    rows = [("q", c, i, k) for c, ids in lists.items() for k, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "query_key string, channel string, item_id string, rank int")


def order(df):
    return [r["item_id"] for r in df.orderBy("rank").collect()]


def rrf(lists, weights, k, top):
    score, best = {}, {}
    for ids, w in zip(lists, weights):
        for n, i in enumerate(dict.fromkeys(ids), 1):
            score[i] = score.get(i, 0.0) + w / (k + n)
            best[i] = min(best.get(i, 10**9), n)
    return sorted(score, key=lambda i: (-round(score[i], 12), best[i], i))[:top]


def test_unique_top(spark):
    df = ranks(spark, {"x": ["a", "a", "b"]})
    assert order(ranking.unique_top(df, 2)) == ["a", "b"]
    assert order(ranking.unique_top(df, 1)) == ["a"]
    assert order(ranking.unique_top(df, 0)) == ["a", "b"]


@pytest.mark.parametrize("weights", [[1.0, 1.0, 1.0], [1.0, 0.75, 1.25], [1.0, 0.0, 2.0]])
def test_fuse_matches_plain_fusion(spark, weights):
    rng = np.random.default_rng(3)
    lists = {c: [f"i{n}" for n in rng.integers(0, 12, 15)] for c in "abc"}
    got = order(ranking.fuse(ranks(spark, lists), dict(zip("abc", weights)), 20, 8))
    assert got == rrf([x for x, w in zip(lists.values(), weights) if w], [w for w in weights if w], 20, 8)


def test_fuse_ignores_repeats(spark):
    a = ranks(spark, {"x": ["a", "b"], "y": ["b", "c"]})
    b = ranks(spark, {"x": ["a", "a", "b", "a"], "y": ["b", "b", "c"]})
    assert order(ranking.fuse(a, {"x": 1, "y": 1})) == order(ranking.fuse(b, {"x": 1, "y": 1})) == ["b", "a", "c"]


def test_union_pool_keeps_first_seen_order(spark):
    df = ranks(spark, {"x": ["a", "b", "c"], "y": ["d", "b", "e"]})
    got = ranking.union_pool(df, ["y", "x"], 2).orderBy("position")
    assert [r["item_id"] for r in got.collect()] == ["d", "b", "a"]


def test_ensemble_tie_goes_to_fused(spark):
    df = spark.createDataFrame([("q", "x", 3.0, 1.0, 1), ("q", "y", 2.0, 2.0, 2), ("q", "z", 1.0, 3.0, 3)], "query_key string, item_id string, m0 double, m1 double, fused int")
    assert order(ranking.mean_reciprocal_rank(df, ["m0", "m1"])) == ["x", "z", "y"]


def test_reserve_fill_and_partition(spark):
    a = ranks(spark, {"s": list("abcd")}).drop("channel")
    b = ranks(spark, {"s": list("axby")}).drop("channel")
    assert order(ranking.reserve_fill(a, b, 2, 4)) == ["a", "b", "x", "y"]
    from pyspark.sql import functions as F

    lists = ranks(spark, {"s": list("abcd")})
    assert order(ranking.partition_allowed(lists, F.col("item_id").isin("b", "d"), "stable")) == ["b", "d", "a", "c"]
    assert order(ranking.partition_allowed(lists, F.col("item_id").isin("b", "d"), "hard")) == ["b", "d"]


DOCS = ["ремонт телефона", "ремонт автомобиля", "маникюр", "ремонт ремонт телефона экран", "", "экран телефона"]


def plain_bm25(docs, query, min_df):
    from collections import Counter
    from math import log

    toks = [d.split() for d in docs]
    df = Counter(t for d in toks for t in set(d))
    vocab = {t for t, n in df.items() if n >= min_df}
    length = [sum(t in vocab for t in d) for d in toks]
    avg = max(sum(length) / len(docs), 1)
    out = []
    for d, n in zip(toks, length):
        tf = Counter(d)
        out.append(sum(tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * n / avg)) * log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in set(query.split()) & vocab if tf[t]))
    return out


@pytest.mark.parametrize("min_df", [1, 2])
def test_bm25_scores_match_plain_loops(spark, min_df):
    items = spark.createDataFrame(list(enumerate(DOCS)), "item_id long, doc string")
    index = bm25.fit(items, bm25.Params(min_df=min_df))
    for query in ["ремонт", "ремонт ремонт телефона", "неизвестно", "", "экран маникюр"]:
        q = spark.createDataFrame([(1, query, "")], "query_key long, search_query string, filters string")
        got = {r["item_id"]: r["score"] for r in bm25.score(index, bm25.query_terms(q, prefix=False)).collect()}
        assert [got.get(k, 0.0) for k in range(len(DOCS))] == pytest.approx(plain_bm25(DOCS, query, min_df))


def test_bm25_search_filters_before_the_cut_and_fills(spark):
    items = spark.createDataFrame([(k, d, k % 2 + 1, k % 3, None if k == 1 else 4.0) for k, d in enumerate(DOCS)], "item_id long, doc string, category long, location long, rating double")
    queries = spark.createDataFrame([(1, "ремонт", "", 1, 0, 0, None), (2, "ремонт", "", 0, 1, 0, 3.0), (3, "ремонт", "", 0, 0, 1, None)],
        "query_key long, search_query string, filters string, category long, location long, delivery long, least_rating double")
    index = bm25.fit(items, bm25.Params(min_df=1))
    got = {(r["query_key"], r["item_id"]) for r in bm25.search(index, queries, 10).collect()}
    assert got == {(1, 0), (2, 0), (2, 3), (3, 0), (3, 1), (3, 3)}
    local = {(r["query_key"], r["item_id"]) for r in bm25.search(index, queries, 10, local=True).collect()}
    assert local == {(1, 0)}
    filled = bm25.fill(bm25.search(index, queries, 4), filters.fill_candidates(queries, items, 10), 4)
    assert {r["query_key"]: r["n"] for r in filled.groupBy("query_key").count().withColumnRenamed("count", "n").collect()} == {1: 3, 2: 4, 3: 4}


def test_index_round_trip(spark, tmp_path):
    items = spark.createDataFrame(list(enumerate(DOCS)), "item_id long, doc string")
    index = bm25.fit(items, bm25.Params(min_df=1))
    bm25.save(index, spark, "test_postings", str(tmp_path), buckets=2)
    back = bm25.load(spark, "test_postings", str(tmp_path))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.select(back.postings.columns).collect()))
    assert back.params == index.params
    spark.sql("drop table test_postings")


def test_dense_search(spark):
    vec = [[1.0, 0.0], [0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.7, 0.3], [0.2, 0.8]]
    item = [0, 1, 2, 2, 3, 1]
    meta = {0: ("a", 10, 1, 5.0), 1: ("b", 20, 1, 3.0), 2: ("c", 20, 1, 4.5), 3: ("d", 10, 2, 5.0)}
    p = spark.createDataFrame([(k, *meta[i], v) for k, (i, v) in enumerate(zip(item, vec))], "passage_id long, item_id string, location long, category long, rating double, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], 1, 20, 0, None), (2, [1.0, 0.0], 0, 20, 0, 4.0), (3, [1.0, 0.0], 0, 99, 0, None)],
        "query_key long, qvector array<float>, category long, location long, delivery long, least_rating double")
    g = vectors.search_global(q, p)
    one = lambda df, k: order(df.filter(f"query_key = {k}"))
    assert one(g, 1) == ["a", "b", "c"] and one(g, 2) == ["a", "c", "d"]
    loc = vectors.search_local(q, p)
    assert one(loc, 1) == ["b", "c"] and one(loc, 3) == []


def test_metrics(spark):
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "query_key string, item_id string")
    pred = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "a", 3), ("z", "c", 1)], "query_key string, item_id string, rank int")
    assert metrics.recall_value(pred, truth, 2) == 0.25
    queries = spark.createDataFrame([("q",), ("r",), ("z",)], "query_key string")
    assert metrics.hit_rate(pred, truth, queries, 2).first()["hit_rate"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        metrics.recall_value(pred, truth.limit(0))
    assert metrics.overlap(pred, pred.limit(0), 2, "larger").first()["overlap"] == 0.0


def test_paired_test_and_wilson(spark):
    c = spark.createDataFrame([("q1", 1.0), ("q2", 1.0)], "query_key string, recall double")
    b = spark.createDataFrame([("q1", 0.0), ("q2", 1.0)], "query_key string, recall double")
    rows = [stats.paired_test(c, b, 200, 1, level).first() for level in (0.95, 0.975)]
    assert rows[0]["mean_delta"] == 0.5 and rows[0]["n_queries"] == 2
    assert rows[1]["ci_low"] <= rows[0]["ci_low"] and rows[1]["ci_high"] >= rows[0]["ci_high"]
    low, high = stats.wilson("k", "n")
    row = spark.createDataFrame([(95, 100)], "k int, n int").select(low, high).first()
    assert row[0] < 0.95 < row[1]
    with pytest.raises(ValueError):
        stats.wilson("k", "n", 0.9)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "x string, p double")
    assert {r["x"]: round(r["p_holm"], 9) for r in stats.holm(df).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_pu_bag_sizes(spark):
    rows = [("q", f"i{k}", int(k in (0, 2)), k + 1, k + 1) for k in range(120)]
    frame = spark.createDataFrame(rows, "query_key string, item_id string, label int, fused int, min_rank int")
    bags = [{r["item_id"] for r in sampling.pu_bag(frame, seed).collect()} for seed in (41, 41, 42)]
    assert bags[0] == bags[1] != bags[2]
    assert len(bags[0]) == 50 and {"i0", "i2"} <= bags[0]
    assert sum(int(i[1:]) < 75 for i in bags[0]) >= 32


def test_folds_and_quotas(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(21)], "id long, s string")
    sizes = sorted((r["s"], r["fold"], r["count"]) for r in sampling.folds(df, "s", "id").groupBy("s", "fold").count().collect())
    assert sizes == [("a", 0, 6), ("a", 1, 5), ("b", 0, 5), ("b", 1, 5)]
    assert sum(r["quota"] for r in sampling.proportional_quotas(df, "s", 7).collect()) == 7


def test_null_safe_anti_join_and_one_to_one(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, s string")
    assert [r["k"] for r in joins.without(a, a.filter("k = 1"), ["k", "s"]).collect()] == [2]
    with pytest.raises(ValueError):
        joins.one_to_one(a.union(a), a, ["k"])
    with pytest.raises(ValueError):
        joins.assert_no_leak(a, a, ["k", "s"])


def test_pair_weights(spark):
    frame = spark.createDataFrame([("q", "a", 1, 60), ("q", "b", 0, 10), ("q", "c", 0, 60)], "query_key string, item_id string, label int, place int")
    n = spark.createDataFrame([("q", 2)], "query_key string, n_relevant int")
    got = {r["neg"]: r["weight"] for r in pair_weights(frame, n).collect()}
    step = lambda r: 1 / (1 + np.exp(-(50.5 - r) / 8))
    assert got == {"b": pytest.approx((step(10) - step(60)) / 2)}
    assert frame.select(inside("place", tau=0)).first()[0] == 0.0


def test_learned_ranking_puts_relevant_items_first(spark):
    from rankloom.operators import ltr

    rng = np.random.default_rng(1)
    rows = [(q, f"i{k}", int(k == q % 7), k + 1, float(k == q % 7) + rng.normal(0, 0.05), rng.normal()) for q in range(6) for k in range(10)]
    frame = spark.createDataFrame(rows, "query_key long, item_id string, label int, fused int, f0 double, f1 double")
    n = spark.createDataFrame([(q, 1) for q in range(6)], "query_key long, n_relevant int")
    model = ltr.fit(frame, ["f0", "f1"], n, rounds=1, per_round=3, depth=2, bins=32, k=2)
    top = ltr.rank_by_models(frame, [model], top=1)
    assert top.join(frame.filter("label = 1"), ["query_key", "item_id"]).count() == 6
    assert model.importance()["f0"] > model.importance()["f1"]
