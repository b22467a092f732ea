"""Copies that are kept for many passes: bounded partitions, and numbers of parts in place of keys."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tabloom.operators import partitions, search
from tabloom.operators.assemble import assembler
from tabloom.operators.evaluate import MULTICLASS, make_evaluator
from tabloom.operators.learners import LEARNERS, Setting
from tabloom.operators.split import hash_split, split_number
from tabloom.queries import frames
from tabloom.queries.inputs import LINE_KEYS


def _most(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_partitions_of_a_fit_are_bounded(spark, tmp_path, monkeypatch):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "few"))
    spark.range(8000).repartition(5).write.parquet(str(tmp_path / "many"))
    few, many = (spark.read.parquet(str(tmp_path / n)) for n in ("few", "many"))
    monkeypatch.setattr(partitions, "MOST_ROWS_PER_TASK", 500)
    assert partitions.even_partitions(few) == 8 and partitions.even_partitions(many) is None
    for df, rows in ((few, 4000), (many, 8000)):
        copy = partitions.spread(df, bounded=True)
        assert copy.count() == rows and _most(copy) <= 600
    assert partitions.bounded_partitions(spark.range(4000)) is None and partitions.spread(many) is many
    monkeypatch.setattr(partitions, "MOST_ROWS_PER_TASK", 1_000_000)
    assert partitions.bounded_partitions(many) is None


def test_searches_keep_numbers_not_keys(spark, monkeypatch):
    df = assembler(["x"]).transform(spark.range(300).selectExpr(
        "id", "id % 7 AS x", "CAST(id % 7 > 3 AS double) AS label"))
    seen = []
    learner = LEARNERS["decision_tree"]
    evaluator = make_evaluator(MULTICLASS, "f1")

    @contextmanager
    def watched(rows, rows_per_task=None):
        seen.append((rows.columns, rows.count()))
        with partitions.kept(rows, rows_per_task) as copy:
            yield copy

    monkeypatch.setattr(search, "kept", watched)
    for method in ("cross_validation", "single_split"):
        _, score = search.grid_search(df, learner, Setting(), evaluator, ["id"], method, portable=True)
        assert score.value > 0.9
    assert [(set(c), n) for c, n in seen] == [({"label", "features", "held", "fold"}, 300)] * 2
    numbered = search._numbered(df, learner.estimator(Setting()), evaluator, {"fold": split_number([1, 1, 1], ["id"], 4, True)})
    parts = hash_split(df, [1, 1, 1], ["id"], 4, portable=True)
    assert [numbered.filter(F.col("fold") == i).count() for i in range(3)] == [p.count() for p in parts]


def test_the_copy_of_the_feature_frame_has_no_keys(spark, monkeypatch):
    copied = []

    @contextmanager
    def watched(df):
        copied.append(df.columns)
        with partitions.working_copy(df) as rows:
            yield rows

    monkeypatch.setattr(frames, "working_copy", watched)
    df, model = frames._auto(spark, "/root/testdata/sf0.001")
    assert not set(copied[0]) & set(LINE_KEYS) and set(LINE_KEYS) <= set(df.columns)
    assert model.transform(df).count() == df.count() and not set(model.columns) & set(LINE_KEYS)
