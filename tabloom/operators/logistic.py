"""Binary logistic regressions fitted side by side by matrix blocks.

The models are those of ``pyspark.ml`` and so is what they minimise: the mean log loss plus the elastic net on slots of unit
deviation.  Several fits, of other penalties or other slots, share each pass over the rows: a pass gives every fit its loss,
gradient and Hessian, and the driver solves a problem as wide as the vector.  A Newton fit takes some eight passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
from pyspark import RDD, SparkContext
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from tabloom.operators.assemble import slot_map
from tabloom.operators.blocks import block_sums, kept_blocks

# A pass sums a matrix as wide as the vector for each fit; wider vectors are left to the gradient steps of the base class.
WIDEST = 256
# A fit ends when the next step can't lower its objective by more than this share.
GAIN = 1e-10
#: Bins of the scores of a ROC curve, and scores drawn for their edges.
BINS, DRAWN = 10_000, 100_000


@dataclass
class Plan:
    """One fit: its slots, penalty and steps."""

    slots: Sequence[int]
    penalty: float = 0.0
    l1_share: float = 0.0
    steps: int = 100
    intercept: bool = True


@dataclass
class _Fit:
    plan: Plan
    slots: np.ndarray
    at: np.ndarray
    value: float = np.inf
    step: np.ndarray | None = None
    slope: float = 0.0
    share: float = 1.0
    taken: int = 0
    done: bool = False
    tried: np.ndarray = field(init=False)

    def __post_init__(self):
        self.tried = self.at

    def cost(self, at: np.ndarray) -> float:
        l1 = self.plan.penalty * self.plan.l1_share
        return l1 * np.abs(at[:-1]).sum() + 0.5 * (self.plan.penalty - l1) * at[:-1] @ at[:-1]

    def learn(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Take the step that was tried, or half of it next time, and find the next."""
        value = loss + self.cost(self.tried)
        if self.step is not None and not value <= self.value + 1e-4 * self.share * self.slope:
            self.share /= 2
            self.done = self.share < 1e-6
            self.tried = self.at + self.share * self.step
            return
        self.at, self.value, self.taken = self.tried, value, self.taken + (self.step is not None)
        if not self.plan.intercept:
            gradient, hessian = gradient.copy(), hessian.copy()
            gradient[-1] = hessian[-1, :] = hessian[:, -1] = 0
        l1 = self.plan.penalty * self.plan.l1_share
        ridge = np.r_[np.full(len(self.at) - 1, self.plan.penalty - l1), 0.0]
        smooth, curve = gradient + ridge * self.at, hessian + np.diag(ridge)
        self.step = lasso_step(self.at, smooth, curve, l1) if l1 > 0 else -_solve(curve, smooth)
        self.share = 1.0
        self.slope = float(smooth @ self.step) + l1 * (np.abs(self.at + self.step)[:-1].sum() - np.abs(self.at)[:-1].sum())
        self.done = self.taken >= self.plan.steps or not -self.slope > GAIN * abs(self.value)
        self.tried = self.at + self.step


def _solve(curve: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """The shortest solution: slots may depend on each other."""
    values, vectors = np.linalg.eigh(curve)
    good = values > max(1e-11 * values[-1], 1e-300)
    return vectors[:, good] @ ((vectors[:, good].T @ gradient) / values[good])


def lasso_step(at: np.ndarray, gradient: np.ndarray, curve: np.ndarray, l1: float) -> np.ndarray:
    """The step to the least of the quadratic plus the absolute values, the last weight free, by coordinate descent."""
    step, slope = np.zeros_like(at), gradient.copy()
    limits = np.r_[np.full(len(at) - 1, l1), 0.0]
    diagonal = np.diag(curve)
    for _ in range(2000):
        largest = 0.0
        for i in np.flatnonzero(diagonal > 1e-14):
            here = at[i] + step[i]
            free = here - slope[i] / diagonal[i]
            new = np.sign(free) * max(0.0, abs(free) - limits[i] / diagonal[i])
            if new != here:
                slope += curve[:, i] * (new - here)
                step[i] += new - here
                largest = max(largest, abs(new - here))
        if largest < 1e-10 * (1 + np.abs(at).max(initial=0.0)):
            break
    return step


def _moments(blocks: RDD, width: int) -> tuple[float, float, float, np.ndarray, np.ndarray]:
    """Rows, sum and largest of the labels, means and sample deviations of the slots."""
    def sums(x, y):
        return np.r_[len(x), y.sum(), ((y != 0) & (y != 1)).sum(), x.sum(0)]

    total = block_sums(blocks, sums)
    if total is None:
        raise ValueError("no rows to fit")
    rows, mean = total[0], total[3:] / total[0]
    squares = block_sums(blocks, lambda x, y: ((x - mean) ** 2).sum(0))
    return rows, total[1], total[2], mean, np.sqrt(squares / max(1.0, rows - 1))


def fit_side_by_side(blocks: RDD, width: int, plans: Sequence[Plan]) -> list[tuple[np.ndarray, float]] | None:
    """(coefficients over all slots, intercept) of each plan; None if a label is neither 0 nor 1."""
    rows, positive, strange, mean, deviation = _moments(blocks, width)
    if strange:
        return None
    if positive in (0, rows):  # one class: the intercept says it all
        sure = np.inf if positive else -np.inf
        return [(np.zeros(width), sure if p.intercept else 0.0) for p in plans]
    fits = []
    for plan in plans:
        slots = np.array([s for s in plan.slots if deviation[s] > 0], int)
        at = np.zeros(len(slots) + 1)
        at[-1] = np.log(positive / (rows - positive)) if plan.intercept else 0.0
        fits.append(_Fit(plan, slots, at))
    # Without an intercept the slots must not be centred.
    shift = {True: mean, False: np.zeros(width)}
    while live := [f for f in fits if not f.done]:
        asked = [(f.slots, f.tried, shift[f.plan.intercept][f.slots], deviation[f.slots]) for f in live]
        total = block_sums(blocks, lambda x, y: _sums(x, y, asked)) / rows
        for f in live:
            k = len(f.tried)
            loss, gradient, hessian = total[0], total[1:1 + k], total[1 + k:1 + k + k * k].reshape(k, k)
            total = total[1 + k + k * k:]
            f.learn(loss, gradient, hessian)
    found = []
    for f in fits:
        weights = np.zeros(width)
        weights[f.slots] = f.at[:-1] / deviation[f.slots]
        found.append((weights, float(f.at[-1] - weights @ shift[f.plan.intercept])))
    return found


def _sums(x: np.ndarray, y: np.ndarray, asked: Sequence[tuple]) -> np.ndarray:
    """Loss, gradient and Hessian of each fit, one after the other."""
    out = []
    for slots, at, shift, deviation in asked:
        own = np.empty((len(x), len(slots) + 1))
        own[:, :-1] = (x[:, slots] - shift) / deviation
        own[:, -1] = 1
        score = own @ at
        chance = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        weighted = own * (chance * (1 - chance))[:, None]
        out += [[np.logaddexp(0, score).sum() - y @ score], (chance - y) @ own, (own.T @ weighted).ravel()]
    return np.concatenate(out)


def roc_areas(blocks: RDD, models: Sequence[tuple[np.ndarray, float]]) -> list[float]:
    """Area under the ROC curve of each linear model, from ten thousand bins of its scores, whose rows are all counted.

    The edges are quantiles of drawn scores; scores that are few have a bin each."""
    weights = np.column_stack([w for w, _ in models])
    intercepts = np.array([b if np.isfinite(b) else 0.0 for _, b in models])
    each = max(1, DRAWN // max(1, blocks.count()))

    def drawn(block):
        x = np.frombuffer(block[1], "<f8").reshape(block[0], -1)
        return x[np.linspace(0, len(x) - 1, min(each, len(x))).astype(int)] @ weights + intercepts

    parts = blocks.map(drawn).collect()
    if not parts:
        return [0.0] * len(models)
    scores = np.vstack(parts)
    edges = [np.unique(np.quantile(scores[:, j], np.linspace(0, 1, BINS), method="nearest")) for j in range(len(models))]

    def counts(x, y):
        found = x @ weights + intercepts
        out = np.zeros((2, len(models), BINS + 1))
        for j, e in enumerate(edges):
            # Sums of products in another order differ in the last digits.
            at = np.searchsorted(e, found[:, j] - 1e-12 * np.abs(found[:, j]), side="left")
            out[0, j] = np.bincount(at, y, BINS + 1)
            out[1, j] = np.bincount(at, 1 - y, BINS + 1)
        return out

    positive, negative = block_sums(blocks, counts)
    below = np.cumsum(negative, 1) - negative
    pairs = positive.sum(1) * negative.sum(1)
    won = (positive * (below + negative / 2)).sum(1)
    return [float(w / p) if p else 0.0 if not a.sum() else 1.0 for w, p, a in zip(won, pairs, positive)]


class BlockLogisticRegression(LogisticRegression):
    """Logistic regression whose binary fits go by blocks; ``fitMultiple`` fits all its parameter maps side by side.

    Other label values, weights, bounds, raw slots and very wide vectors go the way of the base class."""

    def _plain(self) -> bool:
        bounds = ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
        return (self.isDefined("weightCol") or any(self.isDefined(b) for b in bounds) or not self.getStandardization()
                or self.getFamily() == "multinomial")

    def plan(self, slots: Sequence[int]) -> Plan:
        return Plan(slots, self.getRegParam(), self.getElasticNetParam(), self.getMaxIter(), self.getFitIntercept())

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        return self._together(dataset, [self])[0]

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        copies, lock, made = [self.copy(extra) for extra in paramMaps], Lock(), []
        names = {(c.getFeaturesCol(), c.getLabelCol()) for c in copies}

        def one(index: int) -> LogisticRegressionModel:
            with lock:
                if not made:
                    made.extend(self._together(dataset, copies) if len(names) == 1 else [c._fit(dataset) for c in copies])
            return made[index]

        return _FitMultipleIterator(one, len(copies))

    def _together(self, dataset: DataFrame, copies: "Sequence[BlockLogisticRegression]") -> list[LogisticRegressionModel]:
        first = copies[0]
        width = slot_map(dataset, [first.getFeaturesCol()]).width
        if width <= WIDEST and not any(c._plain() for c in copies):
            blocks = kept_blocks(dataset, first.getFeaturesCol(), first.getLabelCol())
            try:
                found = fit_side_by_side(blocks, width, [c.plan(range(width)) for c in copies])
            finally:
                blocks.unpersist()
            if found:
                return [c.model(*f) for c, f in zip(copies, found)]
        return [LogisticRegression._fit(c, dataset) for c in copies]

    def model(self, weights: np.ndarray, intercept: float) -> LogisticRegressionModel:
        context = SparkContext._active_spark_context
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            self.uid, _py2java(context, Vectors.dense(weights)), float(intercept))
        return self._copyValues(LogisticRegressionModel(made))
