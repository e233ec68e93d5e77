"""Percentiles by summaries, and scans by ranges: exact on skewed, tied and missing values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import orrery as o
from orrery.operators import quantiles, scans
from orrery.operators.quantiles import Rank, bounds, merged, percentiles, ranked, summarized


def weighted(x, w, share):
    by = np.lexsort((w, x))
    x, w = x[by], w[by]
    c = np.cumsum(w) - w[0]
    return np.interp(share, c / c[-1], x) if c[-1] else x[-1]


@pytest.fixture(scope="module")
def skewed():
    rng, n = np.random.default_rng(0), 20_000
    narrow = np.where(rng.random(n) < 0.5, 1 + 1e-6 * rng.random(n), 1e9 * rng.normal(size=n))
    narrow[7] = 1e300
    return pd.DataFrame({"g": rng.integers(0, 5, n), "v": narrow, "u": rng.integers(0, 9, n).astype(float), "w": rng.uniform(0.1, 3, n)})


def test_percentiles_are_exact(spark, skewed):
    holes = skewed.assign(v=skewed["v"].where(skewed.index % 11 != 0))
    df = spark.createDataFrame(holes).withColumn("u", F.when(F.rand(1) < 2, F.col("u"))).repartition(6)
    shares = [(0, 0.5), (1, 0.5), (0, 0.16), (0, 0.0), (0, 1.0), (1, 0.99)]
    got = percentiles(df, F.col("g"), [F.col("v"), F.col("u")], [Rank(*s) for s in shares], groups=6).orderBy("g").toPandas()
    assert got["g"].tolist() == [0, 1, 2, 3, 4]
    for g in range(5):
        own = holes[holes["g"] == g]
        want = [np.percentile(own[["v", "u"][f]].dropna(), 100 * s) for f, s in shares]
        assert np.allclose(got.loc[g].to_numpy()[1:].astype(float), want, rtol=1e-12)
    got = percentiles(df, F.col("g"), [F.col("u")], [Rank(0, 0.3), Rank(0, 0.84)], F.col("w"), groups=5).orderBy("g").toPandas()
    for g in range(5):
        own = holes[holes["g"] == g]
        assert np.allclose(got.loc[g].to_numpy()[1:].astype(float), [weighted(own["u"].to_numpy(), own["w"].to_numpy(), s) for s in (0.3, 0.84)], rtol=1e-12)


def test_ranks_by_number(spark, skewed):
    got = {r["i"]: r["at"] for r in ranked(spark.createDataFrame(skewed), F.lit(0), [F.col("v")], [Rank(0, of=i, parts=37) for i in range(38)], linear=False).collect()}
    s = np.sort(skewed["v"].to_numpy())
    assert [got[i] for i in range(38)] == [s[min(i * len(s) // 37, len(s) - 1)] for i in range(38)]


def test_few_rows_lie_between_bounds(spark, skewed, monkeypatch):
    """Half the rows in a millionth of the range, and one far away: intervals still hold few rows."""
    monkeypatch.setattr(quantiles, "ROWS", 2500)
    plain = spark.createDataFrame(skewed).repartition(4).select(F.lit(0).cast("int").alias("g"), F.col("v").alias("f0"))
    shares = (0.1, 0.5, 0.9)
    for (_, i), (_, low, high) in bounds(plain, [Rank(0, s) for s in shares], 1, False).items():
        inside = ((skewed["v"] > low) & (skewed["v"] <= high)).sum()
        assert low < np.percentile(skewed["v"], 100 * shares[i]) <= high and inside <= 3 * len(skewed) / quantiles.CUTS + 20


def test_summaries_keep_ties_and_weights():
    g, v, below, reached, first = summarized(np.array([1, 0, 0, 0, 1]), np.array([5.0, 2, 2, 7, 5]), np.array([1.0, 3, 2, 4, 0.5]), cuts=1000)
    assert reached.sum() == below.sum() == 10.5 and sorted(first[~np.isnan(first)]) == [0.5, 2] and set(g) == {0, 1}
    assert all(len(x) == 0 for x in summarized(*[np.zeros(0)] * 3))
    assert merged([(3, 4), (0, 1), (1, 2), (0, 0.5)]) == [(0, 2), (3, 4)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert percentiles(empty, F.col("g"), [F.col("v")], [Rank(0, 0.5)]).count() == 0
    one = spark.createDataFrame([(0, 4.0), (0, None), (0, float("nan")), (None, 1.0), (7, 2.0)], "g int, v double")
    assert [tuple(r) for r in percentiles(one, F.col("g"), [F.col("v")], [Rank(0, 0.3)], groups=2).collect()] == [(0, 4.0)]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,)], "v double")
    assert percentiles(ends, F.lit(0), [F.col("v")], [Rank(0, 0.5)]).first()["r0"] == 1.0


def test_places_with_a_frequent_key(spark):
    """All rows share the first key: ranges go by the columns after it."""
    df = spark.range(5000).select(F.lit(1.0).alias("k1"), (5000 - F.col("id")).alias("k2")).repartition(4)
    s = o.Snapshot(df, order=("k1", "k2")).numbered()
    assert s.df.where(F.col("pid") != F.col("k2") - 1).isEmpty() and s.df.count() == 5000
    sizes = [r["count"] for r in scans.dealt(df, "k1", "k2").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000
    assert o.Snapshot(df.limit(0), order=("k1",)).numbered().df.count() == 0


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(1, 9, 3000).astype(float)
    got = scans.running_sum(spark.createDataFrame(pd.DataFrame({"k": np.arange(3000), "w": v})).repartition(5), "k", "w", "c").orderBy("k").toPandas()
    assert (got["c"].to_numpy() == np.cumsum(v)).all()


def test_first_crossing_over_ranges(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(size=2000)
    held = np.cumsum(d)
    steps = spark.createDataFrame(pd.DataFrame({"r": np.arange(2000) / 7.0, "late": 0, "d": d})).repartition(5)
    for level in (5.0, -20.0, 1e6):
        def find(r, was, now, after, level=level):
            at = r[(was < level) != (now < level)]
            return float(at[0]) if len(at) else None

        met = np.flatnonzero((np.concatenate([[0.0], held[:-1]]) < level) != (held < level))
        assert scans.first_crossing(steps, 0.0, find) == (met[0] / 7.0 if len(met) else None)
