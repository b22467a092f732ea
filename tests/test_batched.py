"""Fits by matrix blocks, playouts drawn ahead, slot types for trees, and the bound on fits."""

from __future__ import annotations

import threading
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from tabloom.operators import blocks, factorization, select
from tabloom.operators.assemble import assembler, slicer
from tabloom.operators.concurrent import Gate, run_together
from tabloom.operators.encode import category_encoder, tree_slots
from tabloom.operators.evaluate import Score
from tabloom.operators.learners import LEARNERS, Setting


def _frame(spark, n=400, parts=5):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = 1 + x[:, 0] - 2 * x[:, 1] + 3 * x[:, 0] * x[:, 2]
    rows = [(Vectors.dense(r) if i % 2 else Vectors.sparse(3, range(3), r), float(v), float(v > 1)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["features", "label", "flag"]).repartition(parts)


def test_block_sums(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 60)
    x, y, df = _frame(spark)
    kept = blocks.kept_blocks(df, "features", "label")
    whole = blocks.block_sums(kept, lambda a, b: np.vstack([a.T @ a, b @ a]))
    assert np.allclose(whole, np.vstack([x.T @ x, y @ x]))
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    assert np.allclose(blocks.block_sums(kept, lambda a, b: np.vstack([a.T @ a, b @ a])), whole)
    assert blocks.block_sums(blocks.kept_blocks(df.limit(0), "features"), lambda a, b: a.sum(0)) is None


@pytest.mark.parametrize("binary", [False, True])
def test_gradient_of_the_loss(binary):
    rng = np.random.default_rng(1)
    x, weights = rng.normal(size=(20, 4)), rng.normal(size=(5, 3))
    weights[-1, 1:] = 0
    y = (rng.random(20) > 0.5).astype(float) if binary else rng.normal(size=20)

    def loss(w):
        score = w[-1, 0] + x @ w[:-1, 0] + sum(
            (w[i, 1:] @ w[j, 1:]) * x[:, i] * x[:, j] for i in range(4) for j in range(i + 1, 4))
        return np.log1p(np.exp(-score * (2 * y - 1))).sum() if binary else ((score - y) ** 2).sum()

    got = factorization.gradient(x, y, weights, binary)
    for i, j in [(0, 0), (2, 1), (3, 2), (4, 0)]:
        step = np.zeros_like(weights)
        step[i, j] = 1e-6
        assert got[i, j] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-6, rel=1e-5, abs=1e-5)


def test_factorization_machines_learn_products(spark, tmp_path):
    x, y, df = _frame(spark)
    fitted = factorization.BlockFMRegressor(maxIter=150, stepSize=0.1, factorSize=4, seed=1).fit(df)
    got, want = zip(*fitted.transform(df).select("prediction", "label").collect())
    assert np.mean((np.array(got) - np.array(want)) ** 2) < 0.05 * np.var(want)
    weights = np.column_stack([fitted.linear.toArray(), fitted.factors.toArray()])
    weights = np.vstack([weights, [fitted.intercept] + [0] * 4])
    again = {round(v, 6) for v in factorization.raw_scores(x, weights)[0]}
    assert {round(v, 6) for v in got} == again
    PipelineModel([fitted]).write().overwrite().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).stages[0].intercept == fitted.intercept
    flags = factorization.BlockFMClassifier(labelCol="flag", maxIter=100, stepSize=0.1, seed=1).fit(df).transform(df)
    assert flags.filter("prediction = flag").count() > 360
    with pytest.raises(ValueError):
        factorization.BlockFMRegressor().fit(df.limit(0))


class _OneByOne(select.SubsetSearch):
    """The search without drawing ahead."""

    def _playouts(self, policy, iterations):
        best = None
        for _ in range(iterations):
            found = self._one_playout(policy)
            best = found if best is None else select._best([best, found])
            policy = select.adapt(policy, best[1])
        return best


@pytest.mark.parametrize("seed", range(6))
def test_drawing_ahead_changes_nothing(seed):
    columns = [f"c{i}" for i in range(9)]
    value = lambda kept: Score("rmse", float(hash(tuple(kept)) % 1000), False)
    plain = _OneByOne(columns, value, seed).nrpa(3, 4)
    ahead = select.SubsetSearch(columns, value, seed)
    found = ahead.nrpa(3, 4)
    assert (found.columns, found.score, list(found.tried.items())) == (plain.columns, plain.score, list(plain.tried.items()))
    assert set(found.tried) <= set(ahead.known) and len(ahead.known) <= 2 * len(found.tried)
    assert select.SubsetSearch(columns, value, seed).nrpa(0, 3).columns == _OneByOne(columns, value, seed).nrpa(0, 3).columns


def test_slots_of_trees_follow_their_columns(spark):
    rows = [(float(i % 3), f"k{i % 5}", f"w{i}", float(i % 5 == 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "few double, k string, wide string, label double")
    frame = category_encoder(df, ["k", "wide"]).transform(df)
    frame = assembler(["few", "ordinal_indexed_k", "ordinal_indexed_wide"]).transform(frame)
    marked = tree_slots(frame, "features", "indexed", 32)
    kinds = marked.schema["indexed"].metadata["ml_attr"]["attrs"]
    assert [a["idx"] for a in kinds["nominal"]] == [1] and kinds["nominal"][0]["num_vals"] == 6
    assert sorted(a["idx"] for a in kinds["numeric"]) == [0, 2]
    cut = slicer([1, 2], "indexed", "cut").transform(marked)
    learner = LEARNERS["decision_tree"]
    model = learner.estimator(Setting(features="cut", label="label", max_bins=32)).fit(cut)
    assert model.transform(cut).filter("prediction = label").count() == 300
    assert tree_slots(df.selectExpr("label").transform(lambda d: assembler(["label"]).transform(d)), "features", "x").count() == 300


def test_gate_bounds_nested_tasks():
    gate, now, most = Gate(2), [0], [0]
    lock = threading.Lock()

    def work(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return i

    inner = gate.through(work)
    got = run_together([lambda j=j: run_together([lambda i=i: inner(i) for i in range(4)], 4) for j in range(3)], 3)
    assert got == [[0, 1, 2, 3]] * 3 and most[0] <= 2
