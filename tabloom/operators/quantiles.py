"""Exact order statistics and quantiles of many columns at once.

The first pass asks the bounded-size quantile sketch for a fixed grid of percentiles of every column.  The
sketch's rank error is bounded, so each target lies between two known grid points, its bracket.  A further
pass counts the rows below, at and between the ends of every bracket and takes the grid of the rows strictly
between them, until the target is an end of its bracket or its rank in a short bracket is exact.  Hot
values become ends and drop out.  A pass moves no data but sketches and the few rows inside brackets, and
shrinks a bracket at least 600-fold: two passes for a million rows, four or five for 10^12.

The first pass reads a fixed number of columns in a job, so plans and results have one size however wide the table is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import as_number
from tabloom.operators.concurrent import run_together

GRID = 4000
ACCURACY = 20_000
MAX_PASSES = 40
COLUMNS_PER_JOB = 16
JOBS = 4  # at a time
# Grid steps that cover the sketch's rank error on both sides, plus one for rounding.
MARGIN = 2 + math.ceil(GRID / ACCURACY)


@dataclass
class _Target:
    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    value: float | None = None
    margin: int = MARGIN


def _parts(items: Sequence, size: int) -> list[Sequence]:
    return [items[i:i + size] for i in range(0, len(items), size)]


def _points() -> Column:
    """The grid as one constant array."""
    text = ",".join(repr(i / GRID) for i in range(GRID + 1))
    return F.split(F.lit(text), ",").cast("array<double>")


def _from_grid(target: _Target, local: int, inside: int, grid: Sequence[float]) -> None:
    """Place the ``local``-th of the ``inside`` rows behind ``grid``: exactly, or by a new bracket."""
    if 2 * inside < GRID:
        # Every rank has a grid point of its own and the sketch has not merged any entries.
        target.value = grid[math.ceil((local - 0.5) * GRID / inside)]
        return
    at = (local - 0.5) * GRID / inside
    low = grid[max(0, math.floor(at) - target.margin)]
    high = grid[min(GRID, math.ceil(at) + target.margin)]
    if low == high:
        target.value = low
    else:
        target.low, target.high = low, high


def _narrow(target: _Target, counts: tuple[int, int, int, int], grid: Sequence[float] | None) -> None:
    """Move the bracket of ``target``, or set its value.  ``counts`` are the rows below the low end, up
    to it, below the high end, and up to it."""
    below, to_low, to_high, through_high = counts
    rank = target.rank
    if not below < rank <= through_high:
        # The sketch promises that this does not happen.
        raise RuntimeError(f"rank {rank} of {target.column} is not between {target.low} and {target.high}")
    if rank <= to_low:
        target.value = target.low
    elif rank > to_high:
        target.value = target.high
    else:
        _from_grid(target, rank - to_low, to_high - to_low, grid)


def order_statistics(df: DataFrame, ranks: dict[str, Sequence[int]],
                     first: dict[str, tuple[int, Sequence[float]]] | None = None) -> dict[tuple[str, int], float]:
    """The ``rank``-th smallest present value (1-based) for each column and rank."""
    first = first if first is not None else _first_pass(df, list(ranks))
    targets = []
    for column, wanted in ranks.items():
        n, grid = first[column]
        for rank in sorted(set(wanted)):
            if not 1 <= rank <= n:
                raise ValueError(f"{column} has {n} values, no rank {rank}")
            target = _Target(column, rank)
            _from_grid(target, rank, n, grid)
            targets.append(target)
    for _ in range(MAX_PASSES):
        brackets = sorted({(t.column, t.low, t.high) for t in targets if t.value is None})
        if not brackets:
            return {(t.column, t.rank): t.value for t in targets}
        counts, grids = _look(df, brackets)
        for target in targets:
            if target.value is None:
                bracket = (target.column, target.low, target.high)
                _narrow(target, counts[bracket], grids.get(bracket))
    raise RuntimeError("order statistics did not converge")


def _first_pass(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, Sequence[float]]]:
    """Per column: its number of present values and their grid."""
    found = run_together([lambda p=part: _first_grids(df, p) for part in _parts(columns, COLUMNS_PER_JOB)], JOBS)
    return {c: grid for part in found for c, grid in part.items()}


def _first_grids(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, Sequence[float]]]:
    values = df.select([as_number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    points = _points()
    row = values.agg(*[e for i in range(len(columns)) for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", points, ACCURACY).alias(f"g{i}"))]).first()
    return {c: (row[f"n{i}"], row[f"g{i}"]) for i, c in enumerate(columns)}


Bracket = tuple[str, float, float]


Bracket = tuple[str, float, float]


def _look(df: DataFrame, brackets: Sequence[Bracket]) -> tuple[dict[Bracket, tuple[int, int, int, int]],
                                                               dict[Bracket, Sequence[float]]]:
    """The counts of each bracket, and the grid of the values strictly inside it.

    Each column of an Arrow batch is sorted once and gives the counts of all its brackets by binary search, so the
    plan doesn't grow with columns or brackets.  A batch sends a row for each bracket, and the few values inside.
    """
    columns = sorted({b[0] for b in brackets})
    values = df.select([as_number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    own = [np.array([i for i, b in enumerate(brackets) if b[0] == c]) for c in columns]
    low, high = (np.array([b[k] for b in brackets], float) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, inside = [], [], []
            for column, at in zip(batch.columns, own):
                x = np.sort(column.drop_null().to_numpy(zero_copy_only=False))
                ends = np.stack([np.searchsorted(x, edge[at], side) for edge in (low, high) for side in ("left", "right")])
                parts = [x[a:b] for a, b in zip(ends[1], ends[2])]
                names += [at, np.repeat(at, [len(p) for p in parts])]
                counts += [ends, np.zeros((4, sum(map(len, parts))), np.int64)]
                inside += [np.full(len(at), np.nan), *parts]
            found = np.concatenate(inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(names).astype(np.int32)), *[pa.array(c) for c in np.concatenate(counts, axis=1)],
                 pa.array(found, mask=np.isnan(found))], ["bracket", "c0", "c1", "c2", "c3", "value"])

    rows = values.mapInArrow(run, "bracket int, c0 long, c1 long, c2 long, c3 long, value double").groupBy("bracket").agg(
        *[F.sum(f"c{j}").alias(f"c{j}") for j in range(4)],
        F.percentile_approx("value", _points(), ACCURACY).alias("grid")).toLocalIterator()
    counts, grids = {}, {}
    for row in rows:
        bracket = brackets[row["bracket"]]
        counts[bracket] = tuple(row[f"c{j}"] for j in range(4))
        if row["grid"] is not None:
            grids[bracket] = row["grid"]
    return counts, grids


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    interpolate: bool = False) -> dict[str, list[float | None]]:
    """Quantiles of the present values of each column, one list per column.

    By default the value at rank ``ceil(p * n)``; with ``interpolate`` the linear interpolation between
    the two neighbouring ranks.  A column without values gives NULLs.
    """
    if not columns:
        return {}
    first = _first_pass(df, columns)
    spots: dict[str, list[tuple[int, int, float]]] = {}
    for c in columns:
        n = first[c][0]
        if not n:
            continue
        if interpolate:
            positions = [p * (n - 1) for p in probabilities]
            spots[c] = [(math.floor(x) + 1, min(math.floor(x) + 2, n), x - math.floor(x)) for x in positions]
        else:
            ranks = [min(n, max(1, math.ceil(p * n))) for p in probabilities]
            spots[c] = [(r, r, 0.0) for r in ranks]
    found = order_statistics(df, {c: [r for low, high, _ in s for r in (low, high)] for c, s in spots.items()},
                             first)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in spots:
            result[c] = [None] * len(probabilities)
            continue
        result[c] = [found[c, low] + share * (found[c, high] - found[c, low]) if share else found[c, low]
                     for low, high, share in spots[c]]
    return result
