"""Gradient fits that share their passes, against those of pyspark.ml."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import together
from tabloom.operators.assemble import SlotMap
from tabloom.operators.blocks import kept_blocks
from tabloom.operators.evaluate import CLASSIFICATION, MULTICLASS, REGRESSION, evaluate, make_evaluator
from tabloom.operators.learners import LEARNERS, Setting
from tabloom.operators.scoring import GradientScorer, JointSubsets, subset_scorer
from tabloom.operators.search import tune


@pytest.fixture(scope="module")
def frames(spark):
    numbers = ", ".join(f"pmod(hash(id, {i}), 1000) / 500D - 1" for i in range(4))
    df = spark.range(3000).selectExpr("id", f"array({numbers}, 1D) AS a", "pmod(hash(id, 9), 100) / 100D AS noise").select(
        "id", array_to_vector("a").alias("features"),
        (F.expr("a[0] + 0.5 * a[1] - a[2] * a[3] + 0.6 * noise > 0.2")).cast("double").alias("flag"),
        F.expr("CAST(CASE WHEN a[0] + noise > 0.9 THEN 2 WHEN a[1] > 0.1 THEN 1 ELSE 0 END AS double)").alias("class"),
        F.expr("a[0] * 3 + a[1] * a[2] + noise").alias("y"))
    kept = df.repartition(3).persist()
    yield kept.filter("id % 4 > 0"), kept.filter("id % 4 = 0")
    kept.unpersist()


def _setting(label, classes=2):
    return Setting(features="features", label=label, width=5, classes=classes, seed=5)


def _fitted(train, label, classes, estimator):
    blocks = kept_blocks(train, "features", label)
    try:
        facts = together.facts_of(blocks, classes)
        return facts, together.fit_together(blocks, [together.fit_of(estimator, range(5), facts)])[0]
    finally:
        blocks.unpersist()


@pytest.mark.parametrize("l1", [0.0, 0.5])
def test_classes_are_told_apart_by_the_same_weights(frames, l1):
    settings = dict(regParam=0.02, elasticNetParam=l1, maxIter=200, tol=1e-12, labelCol="class")
    _, got = _fitted(frames[0], "class", 3, LogisticRegression(**settings))
    want = LogisticRegression(**settings).fit(frames[0])
    off = got.intercepts - want.interceptVector.toArray()
    assert got.weights.T == pytest.approx(want.coefficientMatrix.toArray(), abs=2e-4)
    assert off - off.mean() == pytest.approx(np.zeros(3), abs=2e-4)


def test_hinge_loss_is_as_low_as_that_of_the_estimator(frames):
    train, _ = frames
    estimator = LinearSVC(labelCol="flag", regParam=0.02, maxIter=100)
    facts, got = _fitted(train, "flag", 2, estimator)
    want = estimator.fit(train)
    rows = train.select("features", "flag").collect()
    x, y = np.array([r[0].toArray() for r in rows]), np.array([r[1] for r in rows])

    def loss(w, b):
        return np.maximum(0, 1 - (2 * y - 1) * (x @ w + b)).mean() + 0.01 * ((w * facts.deviation) ** 2).sum()

    assert loss(got.weights[:, 1], got.intercepts[1]) <= loss(want.coefficients.toArray(), want.intercept) * 1.002


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 4)), rng.integers(0, 3, 50).astype(float)
    net = together.NetworkLoss(np.array([0, 2, 3]), (3, 5, 4, 3), 50.0)
    linear = together.LinearLoss(np.array([1, 3]), x.mean(0)[[1, 3]], x.std(0)[[1, 3]], 50.0, 0.1, 3, True, 4)
    for loss, size in ((net, 20 + 24 + 15), (linear, 9)):
        at = rng.normal(size=size)
        _, got = loss.learn(loss.asks(at)(x, y), at)
        for i in range(size):
            move = np.eye(size)[i] * 1e-6
            up, down = (loss.learn(loss.asks(p)(x, y), p)[0] for p in (at + move, at - move))
            assert got[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_perceptrons_do_as_well_as_those_of_the_base_class(frames):
    train, held = frames
    for label, classes, task in (("flag", 2, CLASSIFICATION), ("class", 3, MULTICLASS)):
        settings = dict(layers=[5, 6, classes], maxIter=60, seed=5, labelCol=label)
        evaluator = make_evaluator(task, "f1", label)
        got, want = (evaluate(e(**settings).fit(train).transform(held), evaluator).value
                     for e in (together.BlockPerceptron, MultilayerPerceptronClassifier))
        assert got == pytest.approx(want, abs=0.03)
    rows = train.select("features", F.lit(7.0).alias("flag"))
    with pytest.raises(Exception):
        together.BlockPerceptron(layers=[5, 3, 2], labelCol="flag").fit(rows)


@pytest.mark.parametrize("name,label,task,classes", [
    ("linear_svc", "flag", CLASSIFICATION, 2), ("multilayer_perceptron", "class", MULTICLASS, 3),
    ("logistic_regression", "class", MULTICLASS, 3), ("factorization_machine", "flag", CLASSIFICATION, 2),
    ("factorization_machine_regression", "y", REGRESSION, 0)])
def test_subsets_and_trials_share_their_passes(frames, monkeypatch, name, label, task, classes):
    train, held = frames
    learner, setting, slots = LEARNERS[name], _setting(label, classes), SlotMap(tuple("abcde"), (1,) * 5)
    scorer = subset_scorer(train, held, slots, learner, setting, task)
    assert isinstance(scorer, JointSubsets) and isinstance(scorer.joint, GradientScorer)
    passes, sums = [], together.block_sums
    monkeypatch.setattr(together, "block_sums", lambda *a: (passes.append(1), sums(*a))[1])
    subsets = [["a"], ["b", "c"], ["a", "b", "c", "d"]]
    found = scorer.many(subsets)
    shared = len(passes)
    alone = [scorer([*s]) for s in subsets]
    assert shared < len(passes) - shared
    # The hinge has kinks: sums in another order may end elsewhere.
    assert [s.value for s in found] == pytest.approx([s.value for s in alone], rel=0.01 if name == "linear_svc" else 1e-6)
    scorer.close()
    passes.clear()
    evaluator = make_evaluator(task, None, label)
    tuned = tune(train, held, learner, setting, evaluator, trials=3, seed=2)
    assert len(passes) < 150 and tuned.score.signed == max(s.signed for _, s in tuned.trials)
    got = evaluate(learner.estimator(setting, **tuned.params).fit(train).transform(held), evaluator)
    assert got.value == pytest.approx(tuned.score.value, abs=0.03)


@pytest.mark.parametrize("name", ["linear_regression", "generalized_linear_regression"])
def test_trials_of_linear_learners_come_from_moments(frames, name):
    train, held = frames
    learner, setting, evaluator = LEARNERS[name], _setting("y"), make_evaluator(REGRESSION, None, "y")
    fits, space = [], learner.space(setting)
    counted = type(learner)(**{**learner.__dict__, "make": lambda s: fits.append(1) or learner.make(s)})
    tuned = tune(train, held, counted, setting, evaluator, trials=4, seed=2)
    assert len(fits) < 4 and set(tuned.params) == set(space)
    for params, score in tuned.trials:
        want = evaluate(learner.estimator(setting, **params).fit(train).transform(held), evaluator)
        assert score.value == pytest.approx(want.value, rel=1e-4)
