"""Logistic regressions side by side: the models and scores of fitting one at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors

from tabloom.operators import logistic
from tabloom.operators.assemble import SlotMap
from tabloom.operators.blocks import kept_blocks
from tabloom.operators.evaluate import CLASSIFICATION, make_evaluator
from tabloom.operators.learners import LEARNERS, Setting
from tabloom.operators.scoring import LearnerScorer, subset_scorer
from tabloom.operators.search import tune
from tabloom.operators.select import SubsetSearch


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)) * [1, 5, 0.1, 2] + [0, 20, 3, 0]
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + 0.3 * (x[:, 1] - 20) + rng.normal(size=2000) > 0.2).astype(float)
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(5).cache()


@pytest.mark.parametrize("params", [{}, {"regParam": 0.05}, {"regParam": 0.05, "elasticNetParam": 0.5},
                                    {"regParam": 0.02, "elasticNetParam": 1.0}, {"regParam": 0.01, "fitIntercept": False}])
def test_models_are_those_of_gradient_steps(rows, params):
    got = logistic.BlockLogisticRegression(**params).fit(rows)
    want = LogisticRegression(maxIter=500, tol=1e-12, **params).fit(rows)
    assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), atol=1e-4)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-4)


def test_parameter_maps_share_passes(rows, monkeypatch):
    passes = []
    sums = logistic.block_sums
    monkeypatch.setattr(logistic, "block_sums", lambda *a: passes.append(1) or sums(*a))
    estimator = LEARNERS["logistic_regression"].estimator(Setting())
    one = estimator.fit(rows)
    alone = len(passes)
    models = dict(estimator.fitMultiple(rows, [{estimator.regParam: r} for r in (0.0, 0.1, 0.2)]))
    assert len(passes) <= 2 * alone + 2 and alone <= 12
    assert np.allclose(models[0].coefficients.toArray(), one.coefficients.toArray())
    assert models[2].getRegParam() == 0.2 and abs(models[2].coefficients[0]) < abs(models[1].coefficients[0])


def test_roc_areas_are_the_evaluators(rows):
    model = logistic.BlockLogisticRegression().fit(rows)
    blocks = kept_blocks(rows, "features", "label")
    exact = BinaryClassificationEvaluator(numBins=0).evaluate(model.transform(rows))
    areas = logistic.roc_areas(blocks, [(model.coefficients.toArray(), model.intercept), (np.zeros(4), 1.0)])
    assert areas == pytest.approx([exact, 0.5], abs=1e-9)


def test_searches_score_side_by_side(rows):
    train, validation = rows.randomSplit([0.7, 0.3], 1)
    slots, learner, names = SlotMap(("a", "b", "c", "d"), (1, 1, 1, 1)), LEARNERS["logistic_regression"], "abcd"
    joint = subset_scorer(train, validation, slots, learner, Setting(), CLASSIFICATION)
    subsets = [["a"], ["a", "b"], ["c", "d"]]
    plain = LearnerScorer(train, validation, slots, learner, Setting(), CLASSIFICATION)
    assert [s.value for s in joint.many(subsets)] == pytest.approx([plain(s).value for s in subsets], abs=1e-3)
    assert {"a", "b"} <= set(SubsetSearch(list(names), joint, 1).nrpa(2, 3).columns)
    tuned = tune(train, validation, learner, Setting(), make_evaluator(CLASSIFICATION), 6)
    assert len(tuned.trials) == 6 and tuned.score.signed == max(s.signed for _, s in tuned.trials) > 0.9


def test_other_labels_and_one_class(spark, rows):
    three = rows.selectExpr("features", "CAST(hash(features) % 3 + 2 AS double) AS label").selectExpr("features", "label % 3 AS label")
    assert logistic.BlockLogisticRegression().fit(three).numClasses == 3
    sure = logistic.BlockLogisticRegression().fit(rows.selectExpr("features", "1.0D AS label"))
    assert sure.intercept == float("inf") and not sure.coefficients.toArray().any()
    with pytest.raises(ValueError):
        logistic.BlockLogisticRegression().fit(rows.limit(0))
