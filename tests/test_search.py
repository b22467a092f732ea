"""Scores, subset search, hyperparameter search, learners and whole runs."""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators.assemble import FEATURES, SlotMap, assembler
from tabloom.operators.concurrent import run_together
from tabloom.operators.evaluate import CLASSIFICATION, MULTICLASS, REGRESSION, Score, evaluate, make_evaluator
from tabloom.operators.learners import LEARNERS, RACES, Setting, learner_for, race
from tabloom.operators.scoring import LearnerScorer, MomentScorer, subset_scorer
from tabloom.operators.search import cross_validate, grid_scores, grid_search, optimise, param_grid, validate_once
from tabloom.operators.select import SubsetSearch, adapt, keep_chances, playout
from tabloom.operators.space import Choice, IntUniform, Uniform, parzen_point, random_point
from tabloom.operators.split import hash_split
from tabloom.plans.automl import AutoML, Budget, run_automl
from tabloom.plans.features import AutoFeatures
from tabloom.sources import results
from tabloom.sources.feature_store import RUN

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.random((600, 4)), columns=COLUMNS)
    frame["id"] = range(600)
    frame["value"] = 3 * frame["a"] - 2 * frame["c"] + rng.normal(size=600) * 0.05
    frame["flag"] = (frame["value"] > 0.5).astype(float)
    frame["kind"] = np.digitize(frame["value"], [0.0, 1.0]).astype(float)
    return assembler(COLUMNS).transform(spark.createDataFrame(frame)).repartition(2).cache()


SLOTS = SlotMap(tuple(COLUMNS), (1, 1, 1, 1))


# --- evaluation

def test_metric_dispatch(spark):
    assert make_evaluator(CLASSIFICATION).getMetricName() == "areaUnderROC"
    assert make_evaluator(CLASSIFICATION, "None").getMetricName() == "areaUnderROC"
    assert make_evaluator(CLASSIFICATION, "accuracy").isLargerBetter()
    assert make_evaluator(MULTICLASS).getMetricName() == "f1"
    assert not make_evaluator(REGRESSION).isLargerBetter()
    assert make_evaluator(REGRESSION, "r2").isLargerBetter()
    with pytest.raises(ValueError):
        make_evaluator("clustering")


def test_signed_scores():
    assert Score("rmse", 2.0, False).signed == -2.0 and Score("f1", 0.5, True).signed == 0.5
    assert Score("f1", float("nan"), True).signed == float("-inf")


def test_best_run(spark):
    rows = [results.leaderboard_row("r", n, Score("rmse", v, False)) for n, v in
            (("x", 10.5), ("y", 9.5), ("z", float("nan")), ("w", 9.5))]
    board = results.leaderboard(spark, rows)
    assert results.best_run(board).first()["algorithm"] == "w"
    assert [r["algorithm"] for r in results.ranked(board).collect()] == ["w", "y", "x", "z"]


# --- subset search

def _surrogate(kept):
    """Best at exactly {a, c}."""
    return Score("s", -len(set(kept) ^ {"a", "c"}) * 1.0, True)


def test_nrpa_finds_the_known_best():
    search = SubsetSearch(COLUMNS, _surrogate, seed=1)
    found = search.nrpa(3, 4)
    assert found.columns == ["a", "c"] and found.score.value == 0.0
    assert found.tried == search.tried and len(found.tried) <= 15
    again = SubsetSearch(COLUMNS, _surrogate, seed=1).nrpa(3, 4)
    assert again.columns == found.columns and list(again.tried) == list(found.tried)


def test_stabilised_nrpa_scores_each_subset_once():
    calls = []

    def scorer(kept):
        calls.append(tuple(kept))
        return _surrogate(kept)

    found = SubsetSearch(COLUMNS, scorer, seed=2, parallelism=1).stabilised_nrpa(3, 3, 4)
    assert found.columns == ["a", "c"] and len(calls) == len(set(calls))
    assert SubsetSearch(COLUMNS, scorer, seed=2, parallelism=1).stabilised_nrpa(0, 3, 4).columns


def test_jobs_run_together(spark):
    gate = threading.Barrier(3, timeout=20)
    # Each task waits for the others, so this only ends if they run at the same time.
    assert run_together([lambda i=i: (gate.wait(), i)[1] for i in range(3)], 3) == [0, 1, 2]
    assert run_together([lambda: 5], 3) == [5]


def test_rmse_is_minimised():
    found = SubsetSearch(COLUMNS, lambda kept: Score("rmse", 1.0 + len(set(kept) ^ {"b"}), False), seed=0).nrpa(3, 4)
    assert found.columns == ["b"]


def test_policy():
    policy = np.full((2, 2), 0.5)
    assert keep_chances(policy).tolist() == [0.5, 0.5]
    stepped = adapt(policy, (True, False))
    assert np.allclose(stepped, [[0.75, 0.25], [0.25, 0.75]])
    assert policy.tolist() == [[0.5, 0.5], [0.5, 0.5]]
    never = np.array([[-50.0, 50.0]] * 3)
    assert playout(never, np.random.default_rng(0)) == (False, False, True)
    with pytest.raises(ValueError):
        SubsetSearch([], _surrogate)


@pytest.mark.parametrize("metric", ["rmse", "mse", "r2", "var"])
def test_moment_scores_equal_fitted_scores(spark, table, metric):
    train, validation = hash_split(table, [0.7, 0.3], ["id"])
    setting = Setting(label="value")
    fast = subset_scorer(train, validation, SLOTS, LEARNERS["linear_regression"], setting, REGRESSION, metric)
    assert isinstance(fast, MomentScorer)
    slow = LearnerScorer(train, validation, SLOTS, LEARNERS["linear_regression"], setting, REGRESSION, metric)
    for kept in (["a"], ["b", "d"], COLUMNS):
        assert fast(kept).value == pytest.approx(slow(kept).value, rel=1e-6)
        assert fast(kept).larger_is_better == slow(kept).larger_is_better


def test_moment_scores_with_dependent_and_constant_slots(spark, table):
    df = table.select("id", "value", "a", (F.col("a") * 2).alias("twice"), F.lit(4.0).alias("same"))
    df = assembler(["a", "twice", "same"]).transform(df)
    train, validation = hash_split(df, [0.7, 0.3], ["id"])
    slots = SlotMap(("a", "twice", "same"), (1, 1, 1))
    scorer = MomentScorer(train, validation, slots, Setting(label="value"))
    assert scorer(["a", "twice", "same"]).value == pytest.approx(scorer(["a"]).value, rel=1e-6)
    assert scorer(["same"]).value > scorer(["a"]).value


def test_search_on_data_drops_noise(spark, table):
    train, validation = hash_split(table, [0.7, 0.3], ["id"])
    scorer = subset_scorer(train, validation, SLOTS, LEARNERS["generalized_linear_regression"],
                           Setting(label="value"), REGRESSION)
    found = SubsetSearch(COLUMNS, scorer, seed=4).nrpa(3, 3)
    assert {"a", "c"} <= set(found.columns)


# --- hyperparameters

def test_spaces_stay_legal():
    rng = np.random.default_rng(0)
    space = {"u": Uniform(0.5, 2.0), "i": IntUniform(2, 5), "c": Choice(("p", "q"))}
    trials = []
    for _ in range(200):
        for point in (random_point(space, rng), parzen_point(space, trials[-20:], rng)):
            assert 0.5 <= point["u"] <= 2.0 and point["i"] in (2, 3, 4) and point["c"] in ("p", "q")
            trials.append((point, -abs(point["u"] - 1.0)))


def test_parzen_beats_random_on_average():
    def objective(p):
        return Score("s", -((p["x"] - 0.2) ** 2) - (p["kind"] != "good"), True)

    space = {"x": Uniform(0.0, 1.0), "kind": Choice(("bad", "worse", "good"))}
    best = {s: np.mean([optimise(objective, space, 25, s, seed, 1).score.value for seed in range(20)])
            for s in ("tpe", "random")}
    assert best["tpe"] > best["random"]


def test_optimise_is_repeatable_and_minimises_errors():
    space = {"x": Uniform(0.0, 1.0)}

    def objective(p):
        return Score("rmse", p["x"], False)

    one, two = (optimise(objective, space, 10, "tpe", 7, 2) for _ in range(2))
    assert one.trials == two.trials and len(one.trials) == 10
    assert one.params["x"] == min(p["x"] for p, _ in one.trials)
    with pytest.raises(ValueError):
        optimise(objective, space, 3, "grid")


def test_grids(spark, table):
    sizes = {name: len(param_grid(learner.estimator(Setting(width=4, non_negative=True)),
                                  learner.grid(Setting(width=4, non_negative=True))))
             for name, learner in LEARNERS.items() if learner.grid(Setting(width=4, non_negative=True))}
    assert sizes == {"logistic_regression": 4, "random_forest": 4, "multilayer_perceptron": 8, "decision_tree": 4,
                     "naive_bayes": 6}
    learner = LEARNERS["logistic_regression"]
    estimator = learner.estimator(Setting(label="flag"))
    grid = param_grid(estimator, learner.grid(Setting()))
    evaluator = make_evaluator(CLASSIFICATION, label="flag")
    crossed = cross_validate(table, estimator, grid, evaluator, ["id"])
    assert len(crossed.avgMetrics) == 4 and max(crossed.avgMetrics) > 0.95
    model, held_out = grid_search(table, LEARNERS["decision_tree"], Setting(label="flag"),
                                  make_evaluator(MULTICLASS, label="flag"), ["id"], "single_split")
    assert len(model.validationMetrics) == 4 and held_out.value > 0.8
    with pytest.raises(ValueError):
        grid_search(table, learner, Setting(label="flag"), evaluator, ["id"], "none")
    once = validate_once(table, estimator, grid, evaluator, seed=1)
    named = grid_scores(grid, once.validationMetrics)
    assert named[0][0] == "elasticNetParam=0.0, regParam=0.1" and max(s for _, s in named) > 0.95


# --- learners

@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_learner_with_a_random_point(spark, table, name):
    """Fits with a point of its space and beats a constant."""
    learner = LEARNERS[name]
    task = REGRESSION if REGRESSION in learner.tasks else CLASSIFICATION
    label = "value" if task == REGRESSION else "flag"
    setting = Setting(label=label, width=4, budget=3, non_negative=True)
    train, test = hash_split(table, [0.7, 0.3], ["id"])
    point = random_point(learner.space(setting), np.random.default_rng(3))
    if name.startswith("gradient"):
        point["maxIter"] = 5
    if name == "multilayer_perceptron":
        # Plain gradient descent does not get anywhere in thirty steps.
        point["solver"] = "l-bfgs"
    model = learner.estimator(setting, **point).fit(train)
    metric = "rmse" if task == REGRESSION else "areaUnderROC"
    score = evaluate(model.transform(test), make_evaluator(task, metric, label, raw=learner.raw))
    constant = test.agg(F.stddev_pop("value")).first()[0] if task == REGRESSION else 0.5
    floor = -constant if task == REGRESSION else constant
    if name == "factorization_machine_regression":
        # Thirty gradient steps from a random start need not get far; the score must be a number.
        assert score.signed > float("-inf")
    else:
        assert score.signed > floor


def test_races():
    assert [len(race(t)) for t in (CLASSIFICATION, MULTICLASS, REGRESSION)] == [6, 3, 4]
    assert all(t in LEARNERS[n].tasks for t, names in RACES.items() for n in names)
    with pytest.raises(ValueError):
        learner_for("linear_svc", MULTICLASS)
    with pytest.raises(ValueError):
        learner_for("oracle", CLASSIFICATION)
    with pytest.raises(ValueError):
        race("clustering")
    assert Budget.of(3) == Budget(3, 3, 3, 12) and Budget.split(9) == Budget(3, 3, 3, 3)
    for name, learner in LEARNERS.items():
        space = learner.space(Setting(budget=100, width=3))
        for dim in ("elasticNetParam", "minWeightFractionPerNode"):
            assert name and (dim not in space or space[dim].high <= 1.0)


# --- whole runs

@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(5)
    n = 500
    frame = pd.DataFrame({"id": range(n), "x": rng.random(n), "z": rng.random(n),
                          "k": rng.choice(["p", "q", "r"], n), "on": rng.random(n) > 0.5})
    signal = frame["x"] * 2 + (frame["k"] == "p")
    frame["price"] = signal * 10 + rng.normal(size=n)
    frame["class"] = np.where(signal > 1.2, "high", "low")
    frame["grade"] = np.digitize(signal, [0.8, 1.6])
    frame.loc[::9, "z"] = np.nan
    frame.loc[::11, "k"] = "?"
    frame.loc[3, "class"] = None
    return spark.createDataFrame(frame)


SMALL = Budget(1, 1, 2, 2)


def test_classification_run(spark, raw, tmp_path):
    job = AutoML("class", CLASSIFICATION, budget=SMALL, learners=("logistic_regression", "decision_tree"),
                 keys=("id",), ignore=("price", "grade"), seed=1, model_root=str(tmp_path))
    result = job.run(raw)
    board = results.ranked(result.leaderboard()).collect()
    assert {r["algorithm"] for r in board} == {"logistic_regression", "decision_tree"}
    assert board[0]["score"] > 0.9 and board[0]["algorithm"] == result.best.learner.name
    assert "price" not in result.frame.model.columns and "id" not in result.frame.model.columns
    result.save()
    result.save()  # a run that is saved again replaces its own rows
    stored = results.read_leaderboard(spark, str(tmp_path))
    assert results.best_run(stored).first()["algorithm"] == result.best.learner.name
    loaded = results.load_model(result.model_path(result.best))
    new = raw.filter("id < 50")
    assert [r["prediction"] for r in loaded.transform(new).orderBy("id").collect()] == [
        r["prediction"] for r in result.best.model.transform(new).orderBy("id").collect()]
    path = result.write_feature_group(result.best, "toy", F.lit(7))  # the id of a record is the run's key
    assert result.write_feature_group(result.best, "toy", F.lit(7)) == path  # once more: the run's rows are replaced
    rows = spark.read.parquet(path).drop(RUN)
    assert {int(r["toyID"]) for r in rows.collect()} == {r["id"] for r in result.frame.raw_train.select("id").collect()}
    assert rows.columns[:2] == ["toyID", "EventTime"] and rows.count() == result.frame.raw_train.count()
    defined = spark.read.parquet(str(tmp_path / "feature_definitions")).orderBy("position").collect()
    assert {r["feature"] for r in defined} == set(rows.columns)
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert spark.read.parquet(str(tmp_path / "meta_features")).count() > 0


def test_same_seed_same_result(spark, raw):
    job = AutoML("price", REGRESSION, budget=SMALL, learners=("linear_regression",), keys=("id",),
                 ignore=("class", "grade"), seed=4, baseline=True,
                 spaces={"linear_regression": {"regParam": Uniform(0.5, 0.6)}})
    one, two = job.run(raw).best, job.run(raw.repartition(3)).best
    assert one.selection.columns == two.selection.columns and one.tuned.params == two.tuned.params
    assert one.score.value == pytest.approx(two.score.value, rel=1e-6)
    assert one.score.value < 5 and one.plain.metric == "rmse"
    assert 0.5 <= one.tuned.params["regParam"] <= 0.6 and len(one.tuned.trials) == 2


def test_multiclass_run_without_test_split(spark, raw):
    result = run_automl(raw, "grade", MULTICLASS, budget=1, learners=["multilayer_perceptron"], keys=("id",),
                        ignore=("class", "price"), test_fraction=0.0,
                        features=AutoFeatures("grade", ignore=("class", "price"), budget=1, degree=1,
                                              source="scaledFeatures"))
    assert result.frame.classes == 3 and result.best.score.value > 0.2
    assert result.best.score == result.best.tuned.score


def test_sampler_does_not_depend_on_parallelism(spark):
    space = {"x": Uniform(0.0, 1.0)}
    points = {(sampler, n): [p["x"] for p, _ in optimise(
        lambda p: Score("rmse", (p["x"] - 0.3) ** 2, False), space, 12, sampler, seed=3, parallelism=n).trials]
        for sampler in ("tpe", "random") for n in (1, 4)}
    assert points["tpe", 1] == points["tpe", 4] and points["random", 1] == points["random", 4]
    assert points["tpe", 1][5:] != points["random", 1][5:]
