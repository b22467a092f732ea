"""Factorisation machines fitted by matrix blocks.

The models are those of ``pyspark.ml``; the fit differs in how a step's gradient is computed: each pass multiplies blocks of
rows with the factors in Python tasks instead of walking through the slots of each row.  Steps are full-batch: ``adamW``
(adaptive moments with decoupled weight decay) or ``gd`` (step over the root of its number, L2 penalty).

Parameters follow the base class.  A step that leaves the finite numbers ends the fit at the weights before it; a table
without rows is an error.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame

from tabloom.operators.blocks import kept_blocks
from tabloom.operators.together import few_tasks, fit_together

# Decay of the moments and the guard of their root.
FIRST, SECOND, GUARD = 0.9, 0.999, 1e-8
#: Rows whose products stay in a core's cache.
TOGETHER = 4096


def raw_scores(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, sums of each factor) of rows; ``weights`` has a row for each slot (linear weight, factors) and one for
    the intercept."""
    linear, factors, intercept = weights[:-1, 0], weights[:-1, 1:], weights[-1, 0]
    sums = x @ factors
    return intercept + x @ linear + 0.5 * ((sums ** 2).sum(1) - (x ** 2) @ (factors ** 2).sum(1)), sums


def _slope(score: np.ndarray, y: np.ndarray, binary: bool) -> np.ndarray:
    """The loss' derivative by the score."""
    if not binary:
        return 2 * (score - y)
    sign = 2 * y - 1
    return -sign / (1 + np.exp(np.clip(score * sign, -500, 500)))


def gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, binary: bool) -> np.ndarray:
    """Sum of the loss' gradient over the rows, shaped as the weights; the intercept's row ends with the number of rows."""
    return Sums.many([Sums(np.arange(x.shape[1]), weights, binary)], x, y)[0].reshape(len(weights), -1)


@dataclass
class Sums:
    """The gradient on the slots, as one row of numbers."""

    slots: np.ndarray
    weights: np.ndarray
    binary: bool

    @property
    def size(self) -> int:
        return len(self.weights) * max(2, self.weights.shape[1])

    @staticmethod
    def many(asked: "Sequence[Sums]", x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Fits on other slots have zeros in theirs, so that all share the products."""
        width = x.shape[1]
        full = np.zeros((width + 1, sum(a.weights.shape[1] for a in asked)))
        low, starts = 0, []
        for a in asked:
            starts.append(low)
            full[np.r_[a.slots, width], low:low + a.weights.shape[1]] = a.weights
            low += a.weights.shape[1]
        linear = np.zeros(low, bool)
        linear[starts] = True
        factors, counts = full[:-1] * ~linear, [a.weights.shape[1] for a in asked]
        lengths = np.add.reduceat(factors ** 2, starts, 1)
        moved, slopes = np.zeros((width, low)), np.zeros(len(asked))
        for at in range(0, len(x), TOGETHER):
            rows = x[at:at + TOGETHER]
            squares, sums = rows ** 2, rows @ full[:-1]
            score = full[-1, starts] + sums[:, starts]
            sums[:, starts] = 0
            score += 0.5 * (np.add.reduceat(sums ** 2, starts, 1) - squares @ lengths)
            slope = np.column_stack([_slope(score[:, i], y[at:at + TOGETHER], a.binary) for i, a in enumerate(asked)])
            sums[:, starts] = 1
            sums *= np.repeat(slope, counts, 1)
            moved += rows.T @ sums - factors * np.repeat(squares.T @ slope, counts, 1)
            slopes += slope.sum(0)
        out = []
        for i, (a, low) in enumerate(zip(asked, starts)):
            found = np.zeros((len(a.weights), max(2, counts[i])))
            found[:-1, :counts[i]] = moved[a.slots, low:low + counts[i]]
            found[-1, 0], found[-1, 1] = slopes[i], len(x)
            out.append(found.ravel())
        return out


@dataclass
class Machine:
    """Scores of rows: a prediction, or the margins of both classes."""

    slots: np.ndarray
    weights: np.ndarray
    binary: bool

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = raw_scores(x[:, self.slots], self.weights)[0]
        return np.column_stack([-score, score]) if self.binary else score


def steps(slots: Sequence[int], params: dict, binary: bool) -> Generator[Sums, np.ndarray, Machine]:
    """A fit for ``fit_together``: ``maxIter`` steps, or until a step changes the weights by less than ``tol``."""
    size, slots = params["factorSize"], np.array(slots, int)
    width = len(slots)
    rng = np.random.default_rng(params["seed"] & 0xFFFFFFFF)
    weights = np.zeros((width + 1, 1 + size))
    weights[:-1, 1:] = rng.normal(0.0, params["initStd"], (width, size))
    free = np.ones_like(weights)
    free[:-1, 0], free[-1, 0], free[-1, 1:] = params["fitLinear"], params["fitIntercept"], 0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, params["maxIter"] + 1):
        total = (yield Sums(slots, weights, binary)).reshape(width + 1, -1)
        g = total[:, :weights.shape[1]] / total[-1, 1] * free
        if params["solver"] == "adamW":
            first, second = FIRST * first + (1 - FIRST) * g, SECOND * second + (1 - SECOND) * g ** 2
            move = first / (1 - FIRST ** step) / (np.sqrt(second / (1 - SECOND ** step)) + GUARD)
            new = weights - params["stepSize"] * (move + params["regParam"] * weights)
        else:
            rate = params["stepSize"] / step ** 0.5
            new = weights * (1 - rate * params["regParam"]) - rate * g
        if not np.isfinite(new).all():
            break
        change = np.linalg.norm(new - weights)
        weights = new
        if change < params["tol"] * max(np.linalg.norm(weights), 1.0):
            break
    return Machine(slots, weights, binary)


class _BlockFit:
    """``_fit`` by blocks for both tasks."""

    def steps(self, slots: Sequence[int]) -> Generator[Sums, np.ndarray, Machine]:
        names = ("factorSize", "fitIntercept", "fitLinear", "regParam", "initStd", "maxIter", "stepSize", "tol", "solver", "seed")
        return steps(slots, {n: self.getOrDefault(n) for n in names}, self._binary)

    def _fit(self, dataset: DataFrame):
        blocks = kept_blocks(dataset, self.getFeaturesCol(), self.getLabelCol())
        try:
            first = blocks.map(lambda b: (b[0], len(b[1]))).take(1)
            if not first:
                raise ValueError("no rows to fit")
            width = first[0][1] // 8 // first[0][0]
            weights = fit_together(few_tasks(blocks), [self.steps(range(width))])[0].weights
        finally:
            blocks.unpersist()
        context = SparkContext._active_spark_context
        linear, factors = Vectors.dense(weights[:-1, 0]), weights[:-1, 1:]
        made = self._java_class(context)(self.uid, float(weights[-1, 0]), _py2java(context, linear), _py2java(
            context, DenseMatrix(*factors.shape, factors.T.ravel())))
        return self._copyValues(self._model(made))


class BlockFMRegressor(_BlockFit, FMRegressor):
    _binary, _model = False, FMRegressionModel

    @staticmethod
    def _java_class(context: SparkContext):
        return context._jvm.org.apache.spark.ml.regression.FMRegressionModel


class BlockFMClassifier(_BlockFit, FMClassifier):
    _binary, _model = True, FMClassificationModel

    @staticmethod
    def _java_class(context: SparkContext):
        return context._jvm.org.apache.spark.ml.classification.FMClassificationModel
