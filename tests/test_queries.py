"""Every named query against its oracle SQL on the small tables."""

import decimal
import math

import pytest

import __spark_entry__ as entry
from rankloom.plans import catalog

SQL = catalog.oracle_sql()


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def same(spark, duck, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    return len(got)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in SQL])
def test_query_matches_oracle(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, name, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SQL])
def test_query_repeats(spark, sf_dir, name):
    fn = catalog.queries()[name]
    a, b = (sorted(map(str, fn(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())


def test_paired_test_takes_20000_resamples(spark, sf_dir, monkeypatch):
    from rankloom.operators import stats
    from rankloom.plans import evaluation

    seen, plain_test = [], stats.paired_test
    monkeypatch.setattr(stats, "paired_test", lambda *a, n_resamples=20_000, **k: seen.append(n_resamples) or plain_test(*a, n_resamples=n_resamples, **k))
    evaluation.paired_test(spark, sf_dir)
    assert seen == [20_000]
