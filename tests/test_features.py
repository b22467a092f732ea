"""Imputation, encoding, generation, assembly, outliers and the feature store."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, QuantileDiscretizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.operators import encode, keyed, outliers, partitions
from tabloom.operators.assemble import assembler, normalizer, slicer, slot_map, standardizer
from tabloom.operators.encode import CategoryIndexer, category_encoder, label_indexer, limit_cardinality, slot_indexer
from tabloom.operators.generate import (
    FeatureSpecs,
    GroupThen,
    PairArithmetic,
    QuantileBuckets,
    draw_specs,
    polynomial_names,
    polynomial_slots,
    polynomial_stages,
)
from tabloom.operators.impute import MissingValueExpander
from tabloom.operators.projection import project_2d
from tabloom.plans.features import AutoFeatures
from tabloom.sources import feature_store as store
from tabloom.sources.results import load_model, save_model
from tabloom.sources.tables import dataset_path


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 7 == 0 else float(rng.integers(0, 40)), float(i), "?" if i % 5 == 0 else "abcab"[i % 5],
             i % 3 == 0) for i in range(300)]
    return spark.createDataFrame(rows, "id int, x double, full double, k string, flag boolean").repartition(4).cache()


def test_expander_equals_the_imputer(spark, gaps):
    model = MissingValueExpander(inputCols=["x", "full", "k", "flag"]).fit(gaps)
    got = model.transform(gaps)
    assert got.columns == ["id", "full", "flag", "imputed_mean_x", "imputed_median_x", "imputed_mode_x",
                           "most_common_k", "Unknown_filling_k"]
    assert model.numeric_outputs() == got.columns[3:6] and model.categorical_outputs() == got.columns[6:]
    for strategy in ("mean", "median", "mode"):
        want = Imputer(strategy=strategy, inputCols=["x"], outputCols=["y"], relativeError=0.0).fit(gaps)
        want = {r["id"]: r["y"] for r in want.transform(gaps).collect()}
        for r in got.collect():
            assert r[f"imputed_{strategy}_x"] == pytest.approx(want[r["id"]])
    gap = got.filter("id % 5 = 0").select("most_common_k", "Unknown_filling_k").distinct().collect()
    assert [tuple(r) for r in gap] == [("b", "Unknown")]


def test_expander_learns_from_the_fitted_rows_only(spark, gaps):
    model = MissingValueExpander(inputCols=["x", "full", "k"]).fit(gaps.filter("id < 100"))
    new = spark.createDataFrame([(1000, None, None, None)], "id int, x double, full double, k string")
    row = model.transform(new).first()
    mean = gaps.filter("id < 100").agg(F.avg("x"), F.avg("full")).first()
    assert row["imputed_mean_x"] == pytest.approx(mean[0]) and row["most_common_k"] is not None
    # A column without gaps in training is filled by its training mean.
    assert row["full"] == pytest.approx(mean[1])


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, None), (None, "?")], "x double, k string")
    row = MissingValueExpander().fit(df).transform(df).first()
    assert row["imputed_median_x"] == 0.0 and row["most_common_k"] == "Unknown"


@pytest.mark.parametrize("labels", [100_000, 1])
def test_category_indexer(spark, monkeypatch, labels):
    """As the built-in indexer; with a label limit of one through the sorted lookup table."""
    monkeypatch.setattr(encode, "LABELS", labels)
    values = ["b"] * 5 + ["a"] * 5 + ["c"] * 9 + [None] * 2 + [f"r{i}" for i in range(20)]
    df = spark.createDataFrame([(v, "x") for v in values], "k string, c string").repartition(3)
    model = CategoryIndexer(inputCols=["k", "c"], outputCols=["i", "j"]).fit(df)
    assert isinstance(model, PipelineModel) == (labels > 1)
    want = StringIndexer(inputCols=["k", "c"], outputCols=["i", "j"], handleInvalid="keep").fit(df)
    new = df.unionByName(spark.createDataFrame([("new", None)], "k string, c string"))

    def rows(frame):
        return sorted((tuple(r) for r in frame.collect()), key=repr)

    assert rows(model.transform(new)) == rows(want.transform(new))


@pytest.mark.parametrize("labels", [100_000, 1])
def test_one_hot_slots(spark, monkeypatch, labels):
    """The same slots by either index; zeros for NULL and values that were not there."""
    monkeypatch.setattr(encode, "LABELS", labels)
    three = spark.createDataFrame([(v,) for v in ["a", "a", "a", "b", "b", "c"]], "k string")
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "k string")
    found = category_encoder(three, ["k"]).transform(new).select("k", vector_to_array("one_hot_encoded_k").alias("v"))
    assert {r["k"]: r["v"] for r in found.collect()} == {
        "a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0], "z": [0.0] * 3, None: [0.0] * 3}
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    model = category_encoder(df, ["k"])
    got = {r["k"]: r["v"] for r in model.transform(df).select("k", vector_to_array("one_hot_encoded_k").alias("v")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], None: [0.0, 0.0]}
    assert category_encoder(df, []).transform(df).columns == ["k"]


def test_label_and_slot_indexers(spark):
    df = spark.createDataFrame([("no", 1.0, 10.5), ("no", 2.0, 11.5), ("yes", 2.0, 12.5)], "y string, a double, b double")
    assert label_indexer(df, "y").labels == ["no", "yes"]
    vectors = assembler(["a", "b"]).transform(df)
    indexed = slot_indexer(vectors, "features", "indexed", max_categories=2).transform(vectors)
    got = [r[0] for r in indexed.select(vector_to_array("indexed")).collect()]
    assert got == [[0.0, 10.5], [1.0, 11.5], [1.0, 12.5]]


def test_limit_cardinality(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbccd"] + [(None,)], "k string")
    got = limit_cardinality(df, ["k"], n=2).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 3, "b": 2, "other": 3, None: 1}


def test_buckets_equal_the_exact_discretizer(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 4, 500) * 1.0, "c": 1.0})
    df = spark.createDataFrame(frame)
    names = list(frame)
    ours = QuantileBuckets(inputCols=names, outputCols=[n + "_d" for n in names]).fit(df)
    builtin = QuantileDiscretizer(numBuckets=10, inputCols=names[:2], outputCols=["a_d", "b_d"],
                                  relativeError=0.0, handleInvalid="keep").fit(df)
    key = ["a", "b"]
    got = ours.transform(df).orderBy(key).select("a_d", "b_d").collect()
    assert got == builtin.transform(df).orderBy(key).select("a_d", "b_d").collect()


@pytest.mark.parametrize("rows", [None, 2])
def test_group_then(spark, monkeypatch, gaps, rows):
    if rows:
        monkeypatch.setattr(keyed, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(keyed, "HOT_SHARE", 3)
    frame = gaps.toPandas()
    train = gaps.filter("k != 'a' or k is null")
    model = GroupThen(by="k", values=["x", "full"]).fit(train)
    got = model.transform(gaps).toPandas().set_index("id").sort_index()
    assert len(got) == 300
    known = frame[frame["k"] != "a"]
    for k, part in known.groupby("k"):
        ids = part["id"]
        assert (got.loc[ids, "group_by_k_count"] == len(part)).all()
        assert np.allclose(got.loc[ids, "group_by_k_avg_x"], part["x"].mean())
        assert (got.loc[ids, "group_by_k_max_full"] == part["full"].max()).all()
    # A key that training did not see gets the statistics of all training rows.
    unseen = got.loc[frame.loc[frame["k"] == "a", "id"]]
    assert (unseen["group_by_k_count"] == 0).all()
    assert np.allclose(unseen["group_by_k_avg_x"], known["x"].mean())


def test_draw_specs():
    specs = draw_specs(["a", "b", "c"], ["k"], 4, seed=1)
    assert specs == draw_specs(["a", "b", "c"], ["k"], 4, seed=1)
    assert len(specs.pairs) + len(specs.groups) == 4
    everything = draw_specs(["a", "b", "c"], ["k"], 100)
    assert len(set(everything.pairs)) == 3 and len(set(everything.groups)) == 3
    assert all(a != b for a, b in everything.pairs)
    assert draw_specs(["a"], [], 3) == FeatureSpecs()
    assert draw_specs([], ["k"], 3) == FeatureSpecs()


def test_polynomials(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    for stage in polynomial_stages(["a", "b"]):
        df = stage.transform(df)
    assert df.first()[polynomial_names(["a", "b"])[1]].toArray().tolist() == [2, 4, 8, 3, 6, 12, 9, 18, 27]
    assert slot_map(df, [polynomial_names(["a", "b"])[1]]).width == polynomial_slots(2) == 9


def test_scaling_and_slots(spark):
    df = spark.createDataFrame([(1.0, -3.0, "p"), (0.0, 0.0, "q"), (2.0, 5.0, "p")], "a double, b double, k string")
    df = category_encoder(df, ["k"]).transform(df)
    columns = ["a", "one_hot_encoded_k", "b"]
    df = assembler(columns).transform(df)
    slots = slot_map(df, columns)
    assert slots.width == 4 and list(slots.slots("b")) == [3]
    assert slots.slots_of(["b", "one_hot_encoded_k"]) == [1, 2, 3]
    cut = slicer(slots.slots_of(["b", "a"])).transform(df)
    assert cut.first()["selectedFeatures"].toArray().tolist() == [1.0, -3.0]
    with pytest.raises(ValueError):
        slicer([])
    first = normalizer().transform(df).first()["normFeatures"].toArray()
    assert first.tolist() == [0.2, 0.2, 0.0, -0.6]
    scaled = standardizer(df).transform(df).select(vector_to_array("scaledFeatures").alias("v")).collect()
    assert [r["v"][0] for r in scaled] == pytest.approx([1.0, 0.0, 2.0])


def test_stages_save_and_load(spark, gaps, tmp_path):
    expander = MissingValueExpander(inputCols=["x", "k"])
    pipeline = Pipeline(stages=[expander, PairArithmetic(pairs=[("imputed_mean_x", "full")]),
                                GroupThen(by="most_common_k", values=["full"]),
                                CategoryIndexer(inputCols=["Unknown_filling_k"], outputCols=["i"])])
    model = pipeline.fit(gaps)
    loaded = load_model(save_model(model, str(tmp_path / "m")))
    assert loaded.transform(gaps).orderBy("id").collect() == model.transform(gaps).orderBy("id").collect()
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p")).fit(gaps)
    assert again.transform(gaps).orderBy("id").collect() == model.transform(gaps).orderBy("id").collect()


def test_large_lookups_save_and_load(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(encode, "LABELS", 1)
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 2)
    df = spark.createDataFrame([(f"k{i % 30}", float(i)) for i in range(200)], "k string, x double")
    model = Pipeline(stages=[GroupThen(by="k", values=["x"]),
                             CategoryIndexer(inputCols=["k"], outputCols=["i"])]).fit(df)
    loaded = load_model(save_model(model, str(tmp_path / "m")))
    key = ["k", "x"]
    assert loaded.transform(df).orderBy(key).collect() == model.transform(df).orderBy(key).collect()


def test_outlier_flags(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.normal(size=2000), "b": rng.normal(size=2000)})
    frame.loc[0] = [25.0, -25.0]
    frame.loc[1] = [np.nan, 0.0]
    df = spark.createDataFrame(frame).repartition(4)
    for flagged in (outliers.flag_by_iqr(df, ["a", "b"]), outliers.flag_by_zscore(df, ["a", "b"]),
                    outliers.flag_by_isolation_forest(df, ["a", "b"], trees=30)):
        got = flagged.toPandas()
        assert got.loc[got["a"] == 25.0, "outlier"].tolist() == [-1]
        assert got.loc[got["a"].isna(), "outlier"].tolist() == [0]
        assert (got["outlier"] == 1).mean() > 0.6
        kept = outliers.remove_outliers(flagged)
        assert kept.columns == ["a", "b"] and kept.count() == (got["outlier"] >= 0).sum()
    q1, q3 = frame["a"].quantile([0.25, 0.75])
    flags = outliers.flag_by_iqr(df, ["a"]).toPandas()
    assert ((flags["a"] < q1 - 1.5 * (q3 - q1)) | (flags["a"] > q3 + 1.5 * (q3 - q1))).equals(flags["outlier"] == -1)


def test_small_inputs_are_spread(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", 400)
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert partitions.even_partitions(one) == 3 and partitions.even_partitions(many) is None
    assert partitions.even_partitions(spark.range(10)) is None
    with partitions.working_copy(one) as copy:
        assert copy.is_cached and copy.count() == 1000
    assert not copy.is_cached
    with partitions.working_copy(many) as same:
        assert same is many
    monkeypatch.setattr(partitions, "MOST_ROWS_PER_CORE", 100)
    assert partitions.even_partitions(one) is None


def test_forest_draws_from_a_large_table(spark):
    """More rows than the trees take: each tree sees about its sample."""
    df = spark.range(20000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.unionByName(spark.createDataFrame([(9.0, 9.0)], "a double, b double"))
    flagged = outliers.flag_by_isolation_forest(df, ["a", "b"], trees=20, sample=64).cache()
    assert flagged.count() == 20001
    far = flagged.filter("a = 9.0").first()
    assert far["outlier"] == -1
    assert flagged.filter(F.col("outlier_score") > far["outlier_score"]).count() < 200


def test_forest_on_a_small_table(spark):
    """Every tree sees its sample; partitions don't matter."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.normal(size=(399, 2))] + [(8.0, 8.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    one, eight = ({(r["a"], r["b"]): r["outlier_score"] for r in outliers.flag_by_isolation_forest(
        df.repartition(n), ["a", "b"]).collect()} for n in (1, 8))
    assert one == eight and one[8.0, 8.0] == max(one.values()) > 0.6


def test_projection(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=400)
    frame = pd.DataFrame({"a": base * 10, "b": base * 5 + rng.normal(size=400), "c": rng.normal(size=400), "y": 1})
    df = spark.createDataFrame(frame)
    got = project_2d(df, ["a", "b", "c"], ["y"])
    assert got.columns == ["y", "pc1", "pc2"] and got.count() == 400
    assert abs(np.corrcoef(got.toPandas()["pc1"], frame["a"])[0, 1]) > 0.99
    assert project_2d(df, ["a", "b"]).first()["pc1"] == pytest.approx(frame["a"][0])


def test_short_names():
    long = "x" * 70
    names = store.short_names([long + "a", long + "b", "plain", long[:63]])
    assert names["plain"] == "plain" and names[long[:63]] == long[:63]
    assert len(set(names.values())) == 4 and all(len(v) <= 63 for v in names.values())


def test_feature_group(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 0.5, "a"), (1, 20, 1.5, "b"), (2, 5, 2.5, "c"), (1, 20, 9.5, "z")],
                               "id int, t int, v double, s string")
    assert store.feature_definitions(df, ["v", "s", "t"], "dID") == [
        ("t", "Integral"), ("v", "Fractional"), ("s", "String"), ("dID", "String"), ("EventTime", "String")]
    rows = store.feature_rows(df, ["v", "s"], F.col("id"), F.col("t"), "dID")
    store.write_feature_group(rows, str(tmp_path), "g")
    store.write_definitions(spark, store.feature_definitions(df, ["v"], "dID"), str(tmp_path), "g")
    back = store.read_feature_group(spark, str(tmp_path), "g")
    assert back.count() == 4
    latest = store.latest_rows(back, "dID", tie_break=["v"]).orderBy("dID").collect()
    assert [(r["dID"], r["EventTime"], r["v"]) for r in latest] == [("1", 20, 9.5), ("2", 5, 2.5)]
    assert spark.read.parquet(str(tmp_path / "feature_definitions")).count() == 3
    ids = [r["id"] for r in store.add_id(df.drop("id").repartition(3)).collect()]
    assert len(set(ids)) == 4 and min(ids) >= 0


def test_dataset_path():
    assert dataset_path("s3a://b/d/", "t") == "s3a://b/d/t.parquet"
    assert dataset_path("/d", "t", "True") == "/d/t-train.parquet"
    with pytest.raises(ValueError):
        dataset_path("/d", "t", "maybe")


def test_auto_features(spark, gaps):
    df = gaps.withColumn("y", (F.col("full") > 150).cast("int"))
    model = AutoFeatures("y", ignore=("id",), budget=3, seed=2).fit(df.filter("id < 200"))
    test = df.filter("id >= 200").unionByName(
        spark.createDataFrame([(900, None, None, "new", None, 1)], df.schema))
    out = model.transform(test)
    assert out.count() == 101
    widths = {r["features"].size for r in out.select("features").collect()}
    assert widths == {model.slots.width}
    assert not any(math.isnan(v) for r in out.collect() for v in r["features"].toArray())
    assert "id" not in model.columns and "y" not in model.columns
    assert model.slots.columns == tuple(model.columns)


@pytest.mark.parametrize("schema, source", [("a double, y int", "scaledFeatures"), ("k string, y int", "normFeatures")])
def test_auto_features_of_one_kind(spark, schema, source):
    """A table with only numeric or only categorical columns."""
    value = 1.5 if "double" in schema else "p"
    df = spark.createDataFrame([(value, 1), (value * 2, 0), (value, None)], schema)
    model = AutoFeatures("y", source=source).fit(df)
    assert model.transform(df).count() == 3 and source in model.transform(df).columns
    with pytest.raises(ValueError):
        AutoFeatures("y").fit(df.select("y"))
