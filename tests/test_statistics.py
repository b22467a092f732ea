"""Tallies, quantiles, ranks and keyed joins, against brute force on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import keyed, profile, quantiles, tally
from tabloom.operators.ordering import ordered
from tabloom.operators.quantiles import exact_quantiles, order_statistics


def _skewed(rng, n):
    """A third of the values is one constant."""
    values = np.round(rng.normal(size=n) * 100, 2)
    values[rng.random(n) < 0.34] = 7.0
    return values


def test_most_frequent_and_distinct(spark):
    rows = [("b", "x"), ("a", "x"), ("b", None), ("a", "?"), (None, "?"), ("c", "?")]
    df = spark.createDataFrame(rows, "p string, q string")
    counts = tally.count_values(df, tally.present_text(df, ["p", "q"]))
    got = {r["column"]: (r["value"], r["n"]) for r in tally.most_frequent(counts).collect()}
    # Ties go to the smaller value, markers are not values.
    assert got == {"p": ("a", 2), "q": ("x", 2)}
    assert {r["column"]: r["n_distinct"] for r in tally.distinct_counts(counts).collect()} == {"p": 3, "q": 1}
    assert tally.max_count_distinct(df, ["p", "q"]) == 4
    assert tally.max_count_distinct(df, []) == 2


@pytest.mark.parametrize("grid", [4000, 20])
def test_exact_quantiles(spark, monkeypatch, grid):
    """A coarse grid forces many passes over brackets; the result is the same."""
    monkeypatch.setattr(quantiles, "GRID", grid)
    rng = np.random.default_rng(grid)
    frame = pd.DataFrame({"a": _skewed(rng, 9001), "b": rng.integers(0, 4, 9001).astype(float),
                          "c": rng.random(9001), "d": np.arange(9001) * 1.0})
    frame.loc[::5, "c"] = np.nan
    df = spark.createDataFrame(frame).repartition(5)
    ps = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    exact = exact_quantiles(df, list(frame), ps)
    between = exact_quantiles(df, list(frame), ps, interpolate=True)
    for c in frame:
        present = frame[c].dropna().to_numpy()
        assert exact[c] == np.quantile(present, ps, method="inverted_cdf").tolist()
        assert np.allclose(between[c], np.quantile(present, ps))


def test_exact_quantiles_of_a_wide_table(spark, tmp_path):
    """Thousands of brackets: plans keep one size, and the default stack holds them."""
    values = np.random.default_rng(3).normal(size=(20_000, 300))
    frame = pd.DataFrame(values, columns=[f"c{i}" for i in range(300)])
    frame.to_parquet(tmp_path / "wide.parquet")
    ps = [i / 10 for i in range(1, 10)]
    got = exact_quantiles(spark.read.parquet(str(tmp_path / "wide.parquet")), list(frame), ps)
    for c in frame:
        assert got[c] == np.quantile(frame[c].to_numpy(), ps, method="inverted_cdf").tolist()


def test_order_statistics_at_a_border_of_hot_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GRID", 20)
    values = [1.0] * 3000 + [1.5] + [2.0] * 3000 + [float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    wanted = [1, 2, 3001, 3002, 3003, 6002, 6003]
    got = order_statistics(df, {"x": wanted})
    assert [got["x", r] for r in wanted] == [sorted(values)[r - 1] for r in wanted]


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5, 0.9]) == {"a": [None, None], "b": [1.0, 1.0]}
    with pytest.raises(ValueError):
        order_statistics(df, {"b": [3]})


def test_ordered_positions(spark):
    rows = [(g, i, 1 + i % 3) for g in ("p", "q") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, n bigint").repartition(6)
    table = ordered(df, "g", [F.col("i").desc()], "n")
    assert table.sizes == {g: (500, sum(1 + i % 3 for i in range(500))) for g in ("p", "q")}
    for g in ("p", "q"):
        got = table.positions(g).orderBy("position").collect()
        assert [r["position"] for r in got] == list(range(500))
        assert [r["i"] for r in got] == list(range(499, -1, -1))
        total = 0
        for r in got:
            assert r["weight_before"] == total
            total += r["n"]


@pytest.mark.parametrize("rows", [None, 3])
def test_spearman(spark, monkeypatch, rows):
    """Mid-ranks with ties and gaps; a row limit forces the join by hot and cold keys."""
    if rows:
        monkeypatch.setattr(keyed, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(keyed, "HOT_SHARE", 10)
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": _skewed(rng, 2000), "b": rng.integers(0, 5, 2000) * 1.0})
    frame["c"] = frame["a"] + rng.normal(size=2000) * 50
    frame.loc[::7, "b"] = np.nan
    got = {(r["a"], r["b"]): r["value"] for r in profile.spearman_matrix(spark.createDataFrame(frame), list(frame)).collect()}
    want = frame.dropna().corr("spearman")
    for a in frame:
        for b in frame:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_pearson_by_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    frame["e"] = 3.0
    df = spark.createDataFrame(frame)
    sql = {(r["a"], r["b"]): r["value"] for r in profile.pearson_matrix(df, list("abcde")).collect()}
    monkeypatch.setattr(profile, "SQL_PAIRS", 0)
    ml = {(r["a"], r["b"]): r["value"] for r in profile.pearson_matrix(df, list("abcde")).collect()}
    want = frame.corr()
    for a in "abcd":
        for b in "abcd":
            assert sql[a, b] == pytest.approx(want.loc[a, b]) and ml[a, b] == pytest.approx(want.loc[a, b])
    assert np.isnan(sql["a", "e"]) and np.isnan(ml["a", "e"])


def test_attach_by_hot_and_cold_keys(spark, monkeypatch):
    """Half of the rows share a key and are copies of each other; NULL is a key like others."""
    keys = ["hot"] * 500 + [f"k{i % 40}" for i in range(400)] + [None] * 60 + ["new"] * 40
    df = spark.createDataFrame([(k, 1) for k in keys], "k string, v int").repartition(6)
    lookup = df.filter("k is null or k != 'new'").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.upper(F.first("k")).alias("u"))
    small = keyed.attach(df, keyed.measure(lookup, "k"))
    large = keyed.measure(lookup, "k", rows=3)
    assert not large.small
    monkeypatch.setattr(keyed, "HOT_SHARE", 10)
    hot, cold = keyed.split_hot(large)
    assert [r["k"] for r in hot.collect()] == ["hot"] and cold.count() == 41
    joined = keyed.attach(df, large)

    def tally_rows(frame):
        return sorted(((r["k"], r["n"], r["u"], r["count"]) for r in frame.groupBy("k", "n", "u").count().collect()),
                      key=repr)

    assert joined.count() == 1000 and joined.columns == ["k", "v", "n", "u"]
    assert tally_rows(joined) == tally_rows(small)
    assert ("new", None, None, 40) in tally_rows(joined) and (None, 60, None, 60) in tally_rows(joined)


def test_hot_rows_do_not_meet_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_SHARE", 10)
    # Keep the cold side from being broadcast, as it would not be at size.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame([("hot", i) for i in range(4000)] + [(f"k{i}", i) for i in range(400)],
                                   "k string, v int").repartition(4)
        lookup = keyed.measure(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", rows=3)
        joined = keyed.attach(df, lookup)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4400 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_describe_and_meta_features(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.gamma(2, size=500), "b": rng.normal(size=500)})
    got = {(r["feature"], r["statistic"]): r["value"]
           for r in profile.meta_features(spark.createDataFrame(frame), ["a", "b"]).collect()}
    centred = frame["a"] - frame["a"].mean()
    assert got["a", "skewness"] == pytest.approx((centred**3).mean() / (centred**2).mean() ** 1.5)
    assert got["a", "kurtosis"] == pytest.approx((centred**4).mean() / (centred**2).mean() ** 2 - 3)
    assert got["a|b", "pearson"] == pytest.approx(frame.corr().loc["a", "b"])
    assert got["a|b", "spearman"] == pytest.approx(frame.corr("spearman").loc["a", "b"])
    assert profile.columns_with_missing(spark.createDataFrame([(1.0, None)], "a double, b string")) == ["b"]
