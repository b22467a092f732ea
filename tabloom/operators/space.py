"""Hyperparameter spaces and the two samplers of the search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: np.random.Generator):
        return float(rng.uniform(self.low, self.high))


@dataclass(frozen=True)
class IntUniform:
    """The integer part of a uniform draw from [low, high)."""

    low: int
    high: int

    def draw(self, rng: np.random.Generator):
        return int(rng.integers(self.low, self.high))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: np.random.Generator):
        return self.options[int(rng.integers(len(self.options)))]


Space = Mapping[str, Uniform | IntUniform | Choice]
# A finished trial: its parameters and its signed score, larger is better.
Trial = tuple[dict, float]


def random_point(space: Space, rng: np.random.Generator) -> dict:
    return {name: dimension.draw(rng) for name, dimension in space.items()}


def parzen_point(space: Space, trials: Sequence[Trial], rng: np.random.Generator, startup: int = 5,
                 good_share: float = 0.25, candidates: int = 24) -> dict:
    """A point from a tree-structured Parzen estimator over the finished trials.

    The best quarter of the trials gives one density, the rest another; of the candidates drawn from the
    first, the one with the largest density ratio is taken, dimension by dimension.
    """
    if len(trials) < startup:
        return random_point(space, rng)
    ranked = sorted(trials, key=lambda t: -t[1])
    cut = max(1, int(np.ceil(good_share * len(ranked))))
    good, rest = [t[0] for t in ranked[:cut]], [t[0] for t in ranked[cut:]]
    return {name: _parzen_dimension(dim, [p[name] for p in good], [p[name] for p in rest], rng, candidates)
            for name, dim in space.items()}


def _parzen_dimension(dim, good: Sequence, rest: Sequence, rng: np.random.Generator, candidates: int):
    if isinstance(dim, Choice):
        weights = [np.array([1.0 + sum(v == o for v in seen) for o in dim.options]) for seen in (good, rest)]
        chances = [w / w.sum() for w in weights]
        picks = rng.choice(len(dim.options), size=candidates, p=chances[0])
        return dim.options[int(max(picks, key=lambda i: chances[0][i] / chances[1][i]))]
    width = dim.high - dim.low
    top = dim.high - 1 if isinstance(dim, IntUniform) else dim.high

    def density(x: np.ndarray, seen: Sequence) -> np.ndarray:
        # The uniform prior counts as one observation.
        spread = width / max(1.0, np.sqrt(len(seen) + 1.0))
        bells = [np.exp(-0.5 * ((x - s) / spread) ** 2) / (spread * np.sqrt(2 * np.pi)) for s in seen]
        return (sum(bells) + 1.0 / width) / (len(seen) + 1)

    spread = width / max(1.0, np.sqrt(len(good) + 1.0))
    centres = rng.choice(np.array([*good, dim.low + width / 2], dtype=float), size=candidates)
    draws = np.clip(rng.normal(centres, spread), dim.low, top)
    if isinstance(dim, IntUniform):
        draws = np.round(draws)
    best = draws[int(np.argmax(density(draws, good) / density(draws, rest)))]
    return int(best) if isinstance(dim, IntUniform) else float(best)
