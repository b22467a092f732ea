"""Fits by gradients whose steps share their passes over the rows.

A fit is a generator: it yields what it wants summed over all blocks, a function of (x, y), gets the sum and ends with its model,
a function from rows to scores.  ``fit_together`` asks for the sums of all fits that are not done in one pass.  The models and
what they minimise are those of ``pyspark.ml``: support vectors by the hinge loss, logistic regression of several classes,
perceptrons of sigmoid layers under a softmax.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, SparkContext
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from tabloom.operators.blocks import block_sums, kept_blocks

#: Pairs of steps and gradient changes that a descent remembers, values it compares a new one with, and steps along a line.
MEMORY, WINDOW, TRIES = 10, 10, 10
#: Bytes of vectors that keep a task busy for a pass.
TASK_BYTES = 8 << 20
#: Numbers of a layer that are computed at a time.
LAYER = 1 << 17

Fit = Generator[Callable, np.ndarray, Callable]


@dataclass(frozen=True)
class Facts:
    """What fits must know of the rows: their number, those of each class, labels that are no class, means and deviations."""

    rows: float
    classes: np.ndarray
    strange: float
    mean: np.ndarray
    deviation: np.ndarray

    @property
    def one_class(self) -> bool:
        return (self.classes > 0).sum() < 2


def facts_of(blocks: RDD, classes: int) -> Facts:
    def sums(x, y):
        known = (y == y.round()) & (y >= 0) & (y < classes)
        return np.r_[len(x), (~known).sum(), np.bincount(y[known].astype(int), minlength=classes), x.sum(0)]

    total = block_sums(blocks, sums)
    if total is None:
        raise ValueError("no rows to fit")
    rows, mean = total[0], total[2 + classes:] / total[0]
    squares = block_sums(blocks, lambda x, y: ((x - mean) ** 2).sum(0))
    return Facts(rows, total[2:2 + classes], total[1], mean, np.sqrt(squares / max(1.0, rows - 1)))


def few_tasks(blocks: RDD) -> RDD:
    """The blocks in tasks that are worth their start: of a small table, several of its kept partitions each."""
    tasks = min(blocks.getNumPartitions(), -(-blocks.map(lambda b: len(b[1])).sum() // TASK_BYTES))
    return blocks.coalesce(max(1, tasks))


def fit_together(blocks: RDD, fits: Sequence[Fit]) -> list[Callable]:
    """The models of the fits."""
    models: list = [None] * len(fits)
    asked: dict[int, Callable] = {}

    def go_on(i: int, total: np.ndarray | None) -> None:
        try:
            asked[i] = fits[i].send(total)
        except StopIteration as end:
            asked.pop(i, None)
            models[i] = end.value

    for i in range(len(fits)):
        go_on(i, None)
    while asked:
        live, wanted = list(asked), list(asked.values())
        total = block_sums(blocks, lambda x, y: _sums(wanted, x, y))
        if total is None:
            raise ValueError("no rows to fit")
        for i, own in zip(live, np.split(total, np.cumsum([w.size for w in wanted])[:-1])):
            go_on(i, own)
    return models


def _sums(wanted: Sequence, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the fits want of a block, one after the other; those of a kind are computed together."""
    found: list = [None] * len(wanted)
    for kind in dict.fromkeys(type(w) for w in wanted):
        mine = [i for i, w in enumerate(wanted) if type(w) is kind]
        for i, own in zip(mine, kind.many([wanted[i] for i in mine], x, y)):
            found[i] = own
    return np.concatenate(found)


def descend(objective: Callable, start: np.ndarray, steps: int, tol: float, l1: np.ndarray | None = None,
            smooth: bool = True) -> Generator[Callable, np.ndarray, np.ndarray]:
    """The weights after limited-memory quasi-Newton steps; ``objective`` has ``asks(at)`` and ``learn(total, at)`` (value, gradient).

    With ``l1`` limits of the weights the steps stay in an orthant.  A smooth objective's steps also satisfy the curvature condition."""
    l1 = None if l1 is None or not l1.any() else l1

    def cost(at):
        return 0.0 if l1 is None else float(l1 @ np.abs(at))

    def steepest(at, g):
        if l1 is None:
            return g
        down, up = g - l1, g + l1
        return np.where(at > 0, up, np.where(at < 0, down, np.where(down > 0, down, np.where(up < 0, up, 0.0))))

    at = start
    value, g = objective.learn((yield objective.asks(at)), at)
    value += cost(at)
    if not (np.isfinite(value) and np.isfinite(g).all()):
        return at
    pseudo, first = steepest(at, g), abs(value)
    values, pairs = [value], []
    for _ in range(steps):
        if np.linalg.norm(pseudo) <= max(tol * abs(value), 1e-8):
            break
        step = -_two_loops(pseudo, pairs)
        if l1 is not None:
            step[step * pseudo >= 0] = 0.0
        slope = float(step @ pseudo)
        if not slope < 0:
            step, pairs = -pseudo, []
            slope = float(step @ pseudo)
        share = 1.0 if pairs else min(1.0, 1 / np.linalg.norm(pseudo))
        side = np.where(at != 0, np.sign(at), -np.sign(pseudo))
        low, high, found = 0.0, np.inf, None
        for _ in range(TRIES):
            new = at + share * step
            if l1 is not None:
                new = np.where(new * side > 0, new, 0.0)
            there, new_g = objective.learn((yield objective.asks(new)), new)
            there += cost(new)
            if not (np.isfinite(there) and np.isfinite(new_g).all()) or there > value + 1e-4 * share * slope:
                high = share
            else:
                found = new, there, new_g
                if not smooth or l1 is not None or new_g @ step >= 0.9 * slope:
                    break
                low = share
            share = (low + high) / 2 if high < np.inf else 2 * share
        if found is None:
            break
        moved, turned = found[0] - at, found[2] - g
        if moved @ turned > 1e-12 * (turned @ turned):
            pairs = [*pairs, (moved, turned)][-MEMORY:]
        at, value, g = found
        pseudo = steepest(at, g)
        if abs(value - max(values)) <= tol * first:
            break
        values = [*values, value][-WINDOW:]
    return at


def _two_loops(g: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse Hessian that the pairs speak of."""
    out, shares = g.copy(), []
    for s, y in reversed(pairs):
        shares.append((s @ out) / (s @ y))
        out -= shares[-1] * y
    if pairs:
        s, y = pairs[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), share in zip(pairs, reversed(shares)):
        out += (share - (y @ out) / (s @ y)) * s
    return out


@dataclass
class Linear:
    """Scores of classes by weights over all slots."""

    weights: np.ndarray
    intercepts: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercepts


@dataclass
class LinearLoss:
    """Loss and gradient of a linear model on centred slots of unit deviation, one column of weights for each class
    (hinge: one in all)."""

    slots: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    rows: float
    ridge: float
    columns: int
    intercept: bool
    width: int

    def unpacked(self, at: np.ndarray) -> Linear:
        own = at.reshape(len(self.slots) + 1, self.columns)
        weights = np.zeros((self.width, self.columns))
        weights[self.slots] = own[:-1] / self.deviation[:, None]
        shift = self.mean @ weights[self.slots] if self.intercept else 0.0
        return Linear(weights, own[-1] - shift)

    def asks(self, at: np.ndarray) -> "LinearSums":
        return LinearSums(self.unpacked(at))

    def learn(self, total: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        slopes = total[1:].reshape(self.width + 1, self.columns)
        shift = self.mean[:, None] * slopes[-1] if self.intercept else 0.0
        gradient = np.vstack([(slopes[self.slots] - shift) / self.deviation[:, None], slopes[-1:] * self.intercept]) / self.rows
        own = at.reshape(gradient.shape)[:-1]
        gradient[:-1] += self.ridge * own
        return total[0] / self.rows + 0.5 * self.ridge * (own ** 2).sum(), gradient.ravel()


@dataclass
class LinearSums:
    at: Linear

    @property
    def size(self) -> int:
        return 1 + (len(self.at.weights) + 1) * self.at.weights.shape[1]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.many([self], x, y)[0]

    @staticmethod
    def many(asked: "Sequence[LinearSums]", x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a.at.weights.shape[1] for a in asked])[:-1]
        scores = x @ np.hstack([a.at.weights for a in asked]) + np.concatenate([a.at.intercepts for a in asked])
        found = [_hinge(s, y) if s.shape[1] == 1 else _softmax(s, y) for s in np.split(scores, ends, 1)]
        products = np.split(x.T @ np.hstack([slope for _, slope in found]), ends, 1)
        return [np.r_[loss, product.ravel(), slope.sum(0)] for (loss, slope), product in zip(found, products)]


def _hinge(score: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of the losses, their slopes)."""
    sign = 2 * y - 1
    off = 1 - sign * score[:, 0]
    return float(np.maximum(off, 0).sum()), (-sign * (off > 0))[:, None]


def _softmax(score: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(sum of the losses, chances less the labels)."""
    score = score - score.max(1, keepdims=True)
    chance = np.exp(score)
    total = chance.sum(1)
    rows, klass = np.arange(len(y)), y.astype(int)
    loss = float((np.log(total) - score[rows, klass]).sum())
    chance /= total[:, None]
    chance[rows, klass] -= 1
    return loss, chance


def _linear_fit(estimator: Estimator, slots: Sequence[int], facts: Facts, columns: int) -> Fit:
    get = estimator.getOrDefault
    slots = np.array([s for s in slots if facts.deviation[s] > 0], int)
    share = get("elasticNetParam") if estimator.hasParam("elasticNetParam") else 0.0
    loss = LinearLoss(slots, facts.mean[slots], facts.deviation[slots], facts.rows, get("regParam") * (1 - share), columns,
                      get("fitIntercept"), len(facts.mean))
    start, limits = np.zeros((len(slots) + 1, columns)), np.zeros((len(slots) + 1, columns))
    limits[:-1] = get("regParam") * share
    if columns > 1 and get("fitIntercept"):
        priors = np.log1p(facts.classes)
        start[-1] = priors - priors.mean()
    at = yield from descend(loss, start.ravel(), get("maxIter"), get("tol"), limits.ravel(), smooth=columns > 1)
    found = loss.unpacked(at)
    # The margin of the class and its opposite.
    return found if columns > 1 else Linear(found.weights * [-1, 1], found.intercepts * [-1, 1])


@dataclass
class Network:
    """Raw scores of the classes by sigmoid layers; weights as in ``pyspark.ml``, layer by layer, a layer's biases last."""

    slots: np.ndarray
    layers: tuple[int, ...]
    weights: np.ndarray

    def parts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, low = [], 0
        for a, b in zip(self.layers, self.layers[1:]):
            out.append((self.weights[low:low + a * b].reshape(a, b), self.weights[low + a * b:low + (a + 1) * b]))
            low += (a + 1) * b
        return out

    def run(self, x: np.ndarray) -> list[np.ndarray]:
        """The input of each layer, and the raw scores."""
        held = [x]
        for k, (w, b) in enumerate(self.parts()):
            z = held[-1] @ w
            z += b
            if k < len(self.layers) - 2:
                np.clip(z, -700, 700, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
            held.append(z)
        return held

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.run(x[:, self.slots])[-1]


@dataclass
class NetworkSums:
    """Loss and gradient of a network."""

    at: Network

    @property
    def size(self) -> int:
        return 1 + len(self.at.weights)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        step = max(1, LAYER // max(self.at.layers))
        for low in range(0, len(x), step):
            out += self.part(x[low:low + step], y[low:low + step])
        return out

    @staticmethod
    def many(asked: "Sequence[NetworkSums]", x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [a(x, y) for a in asked]

    def part(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        held = self.at.run(x[:, self.at.slots])
        loss, slope = _softmax(held[-1], y)
        found = []
        for (w, _), a in zip(reversed(self.at.parts()), reversed(held[:-1])):
            found = [(a.T @ slope).ravel(), slope.sum(0), *found]
            if len(found) < 2 * (len(self.at.layers) - 1):
                slope = slope @ w.T
                slope *= a
                slope *= 1 - a
        return np.concatenate([[loss], *found])


@dataclass
class NetworkLoss:
    slots: np.ndarray
    layers: tuple[int, ...]
    rows: float

    def asks(self, at: np.ndarray) -> NetworkSums:
        return NetworkSums(Network(self.slots, self.layers, at))

    def learn(self, total: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray]:
        return total[0] / self.rows, total[1:] / self.rows


def _network_fit(estimator: Estimator, slots: Sequence[int], facts: Facts) -> Fit:
    get = estimator.getOrDefault
    layers, rng = tuple(get("layers")), np.random.default_rng(get("seed") & 0xFFFFFFFF)
    loss = NetworkLoss(np.array(slots, int), layers, facts.rows)
    at = np.concatenate([rng.uniform(-2.4, 2.4, (a + 1) * b) / a ** 0.5 for a, b in zip(layers, layers[1:])])
    if get("solver") == "l-bfgs":
        at = yield from descend(loss, at, get("maxIter"), get("tol"))
    else:
        for _ in range(get("maxIter")):
            _, g = loss.learn((yield loss.asks(at)), at)
            new = at - get("stepSize") * g
            change, at = np.linalg.norm(new - at), new
            if not change >= get("tol") * max(np.linalg.norm(new), 1.0):
                break
    return Network(loss.slots, layers, at)


def fit_of(estimator: Estimator, slots: Sequence[int], facts: Facts) -> Fit | None:
    """The estimator's fit on the slots; None if it asks for what isn't done here."""
    if estimator.hasParam("weightCol") and estimator.isDefined("weightCol") or facts.strange or not len(slots):
        return None
    if isinstance(estimator, LinearSVC):
        return _linear_fit(estimator, slots, facts, 1) if estimator.getStandardization() else None
    if isinstance(estimator, LogisticRegression):
        bounds = ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts")
        plain = estimator.getStandardization() and estimator.getFamily() != "binomial" and not any(
            estimator.isDefined(b) for b in bounds)
        return _linear_fit(estimator, slots, facts, len(facts.classes)) if plain and not facts.one_class else None
    if isinstance(estimator, MultilayerPerceptronClassifier):
        layers = estimator.getLayers()
        fits = layers[0] == len(slots) and layers[-1] == len(facts.classes) and not estimator.isDefined("initialWeights")
        return _network_fit(estimator, slots, facts) if fits else None
    return None


class BlockPerceptron(MultilayerPerceptronClassifier):
    """Perceptrons fitted by matrix blocks.  Given weights and labels that are no classes go the way of the base class."""

    def _fit(self, dataset: DataFrame):
        blocks = kept_blocks(dataset, self.getFeaturesCol(), self.getLabelCol())
        try:
            facts = facts_of(blocks, self.getLayers()[-1])
            fit = fit_of(self, range(len(facts.mean)), facts)
            found = fit_together(few_tasks(blocks), [fit])[0] if fit else None
        finally:
            blocks.unpersist()
        if found is None or not np.isfinite(found.weights).all():
            return super()._fit(dataset)
        context = SparkContext._active_spark_context
        made = context._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
            self.uid, _py2java(context, Vectors.dense(found.weights)))
        return self._copyValues(MultilayerPerceptronClassificationModel(made))
