"""The learners: estimator, search space and grid of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression

from tabloom.operators.evaluate import CLASSIFICATION, MULTICLASS, REGRESSION
from tabloom.operators.factorization import BlockFMClassifier, BlockFMRegressor
from tabloom.operators.logistic import BlockLogisticRegression
from tabloom.operators.space import Choice, IntUniform, Space, Uniform
from tabloom.operators.together import BlockPerceptron


@dataclass(frozen=True)
class Setting:
    """What a learner must know about the data and the run."""

    features: str = "features"
    label: str = "label"
    width: int = 1
    classes: int = 2
    max_bins: int = 32
    budget: int = 3
    seed: int = 0
    non_negative: bool = False


@dataclass(frozen=True)
class Learner:
    name: str
    tasks: tuple[str, ...]
    make: Callable[[Setting], Estimator]
    space: Callable[[Setting], Space] = lambda s: {}
    grid: Callable[[Setting], dict[str, list]] = lambda s: {}
    # Trees take the slots that hold category indices as such.
    indexed: bool = False
    # Gradient steps need slots of like size: these learners get the standardised vector.
    scaled: bool = False
    # Column that ranks the rows for ROC and PR curves.
    raw: str = "rawPrediction"

    def estimator(self, setting: Setting, **params) -> Estimator:
        made = self.make(setting)
        made._set(featuresCol=setting.features, labelCol=setting.label, **params)
        return made


def _ratio(share: float, s: Setting) -> Uniform:
    """U(0, share * budget), kept inside [0, 1]."""
    return Uniform(0.0, min(1.0, share * s.budget))


def _penalty(share: float, s: Setting) -> Uniform:
    return Uniform(0.0, share * s.budget)


def _layers(s: Setting, *hidden: int) -> list[int]:
    return [s.width, *hidden, s.classes]


# Iterations, search spaces and grids of the learners.
_ALL = [
    Learner(
        "logistic_regression", (CLASSIFICATION, MULTICLASS),
        lambda s: (BlockLogisticRegression if s.classes <= 2 else LogisticRegression)(maxIter=30),
        lambda s: {"regParam": _penalty(0.03, s), "elasticNetParam": _ratio(0.02, s)},
        lambda s: {"regParam": [0.1, 0.01], "elasticNetParam": [0.0, 1.0]}, scaled=True),
    Learner(
        "random_forest", (CLASSIFICATION, MULTICLASS),
        lambda s: RandomForestClassifier(maxBins=max(32, s.max_bins), seed=s.seed),
        lambda s: {"impurity": Choice(("gini", "entropy")), "numTrees": IntUniform(15, 25),
                   "maxDepth": IntUniform(4, 8)},
        lambda s: {"maxDepth": [5, 10], "impurity": ["gini", "entropy"]}, indexed=True),
    Learner(
        "gradient_boosted_trees", (CLASSIFICATION,),
        lambda s: GBTClassifier(maxBins=max(32, s.max_bins), seed=s.seed),
        lambda s: {"minWeightFractionPerNode": Uniform(0.0, 0.499), "minInstancesPerNode": IntUniform(1, 2),
                   "maxDepth": IntUniform(4, 8)}, indexed=True),
    Learner(
        "multilayer_perceptron", (CLASSIFICATION, MULTICLASS),
        lambda s: BlockPerceptron(maxIter=30, layers=_layers(s, s.width), seed=s.seed),
        lambda s: {"solver": Choice(("l-bfgs", "gd")), "stepSize": Uniform(0.03, max(0.04 * s.budget, 0.031)),
                   "layers": Choice((_layers(s, s.width), _layers(s, 2 * s.width)))},
        lambda s: {"layers": [_layers(s, max(1, s.width // 2)),
                              _layers(s, max(1, s.width // 2), max(1, s.width // 2))],
                   "solver": ["l-bfgs", "gd"], "stepSize": [0.03, 0.015]}),
    Learner(
        "linear_svc", (CLASSIFICATION,),
        lambda s: LinearSVC(maxIter=30),
        lambda s: {"regParam": _penalty(0.03, s), "aggregationDepth": IntUniform(2, 6)}, scaled=True),
    Learner(
        "factorization_machine", (CLASSIFICATION,),
        lambda s: BlockFMClassifier(maxIter=30, seed=s.seed),
        lambda s: {"regParam": _penalty(0.03, s), "factorSize": IntUniform(6, 10),
                   "solver": Choice(("adamW", "gd"))}, scaled=True),
    Learner(
        "decision_tree", (CLASSIFICATION, MULTICLASS),
        lambda s: DecisionTreeClassifier(maxDepth=2, maxBins=max(32, s.max_bins), seed=s.seed),
        lambda s: {"maxDepth": Choice((5, 10)), "impurity": Choice(("gini", "entropy"))},
        lambda s: {"maxDepth": [5, 10], "impurity": ["gini", "entropy"]}, indexed=True),
    Learner(
        "naive_bayes", (CLASSIFICATION, MULTICLASS),
        lambda s: NaiveBayes(modelType="multinomial" if s.non_negative else "gaussian"),
        lambda s: {"smoothing": Choice((0.5, 1.0, 1.5)), "modelType": Choice(_bayes_types(s))},
        lambda s: {"smoothing": [0.5, 1.0, 1.5], "modelType": list(_bayes_types(s))},
        # Its raw prediction is the joint likelihood of one class, which does not compare classes.
        raw="probability"),
    Learner(
        "linear_regression", (REGRESSION,),
        lambda s: LinearRegression(maxIter=30),
        lambda s: {"regParam": _penalty(0.03, s), "elasticNetParam": _ratio(0.02, s)}),
    Learner(
        "generalized_linear_regression", (REGRESSION,),
        # The weighted least squares behind it takes 4096 slots; gaussian with identity is plain least squares.
        lambda s: GeneralizedLinearRegression(maxIter=30) if s.width <= 4096 else LinearRegression(maxIter=30),
        lambda s: {"regParam": _penalty(0.03, s)}),
    Learner(
        "gradient_boosted_regression", (REGRESSION,),
        lambda s: GBTRegressor(maxIter=10, maxBins=max(32, s.max_bins), seed=s.seed),
        lambda s: {"minWeightFractionPerNode": Uniform(0.0, 0.499), "minInstancesPerNode": IntUniform(1, 3),
                   "maxDepth": IntUniform(4, 8)}, indexed=True),
    Learner(
        "factorization_machine_regression", (REGRESSION,),
        lambda s: BlockFMRegressor(maxIter=30, seed=s.seed),
        lambda s: {"regParam": _penalty(0.03, s), "initStd": Uniform(1e-6, 0.02 * s.budget)}, scaled=True),
]

LEARNERS: dict[str, Learner] = {learner.name: learner for learner in _ALL}

# The race of each task; decision tree and naive Bayes take part when they are named.
RACES: dict[str, tuple[str, ...]] = {
    CLASSIFICATION: ("logistic_regression", "random_forest", "gradient_boosted_trees",
                     "multilayer_perceptron", "linear_svc", "factorization_machine"),
    MULTICLASS: ("logistic_regression", "random_forest", "multilayer_perceptron"),
    REGRESSION: ("linear_regression", "generalized_linear_regression", "gradient_boosted_regression",
                 "factorization_machine_regression"),
}


def _bayes_types(s: Setting) -> tuple[str, ...]:
    """The multinomial model takes non-negative features only."""
    return ("multinomial", "gaussian") if s.non_negative else ("gaussian",)


def learner_for(name: str, task: str) -> Learner:
    if name not in LEARNERS:
        raise ValueError(f"unknown learner {name!r}")
    learner = LEARNERS[name]
    if task not in learner.tasks:
        raise ValueError(f"{name} does not do {task}")
    return learner


def race(task: str) -> list[Learner]:
    if task not in RACES:
        raise ValueError(f"unknown task {task!r}")
    return [LEARNERS[name] for name in RACES[task]]
