"""Outlier flags: 1 is normal, -1 is an outlier, 0 could not be judged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.columns import as_number, ref
from tabloom.operators.partitions import spread
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.scratch import stored

FLAG = "outlier"
TREES = 100
SAMPLE = 256


def _flag(df: DataFrame, inside: dict[str, Column]) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [as_number(c).isNotNull() for c in inside])
    normal = reduce(lambda a, b: a & b, inside.values())
    return df.withColumn(FLAG, F.when(~complete, F.lit(0)).when(normal, F.lit(1)).otherwise(F.lit(-1)))


def flag_by_iqr(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Outlier if any column lies more than ``reach`` interquartile ranges outside the quartiles."""
    inside = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75], interpolate=True).items():
        q1, q3 = (0.0, 0.0) if q1 is None else (q1, q3)
        fence = reach * (q3 - q1)
        inside[c] = as_number(c).between(q1 - fence, q3 + fence)
    return _flag(df, inside)


def flag_by_zscore(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Outlier if any column is more than ``limit`` sample deviations from its mean."""
    moments = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.avg(as_number(c)).alias(f"m{i}"), F.stddev_samp(as_number(c)).alias(f"s{i}"))]).first()
    inside = {}
    for i, c in enumerate(columns):
        mean, deviation = moments[f"m{i}"] or 0.0, moments[f"s{i}"] or 0.0
        inside[c] = F.abs(as_number(c) - F.lit(mean)) <= F.lit(limit * deviation)
    return _flag(df, inside)


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    long = 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length); a leaf has feature -1."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list = []
    work = [(rows, 0, None, 0)]
    while work:
        part, depth, parent, side = work.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = at
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(part)))])
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([feature, cut, -1, -1, 0.0])
        goes_left = part[:, feature] <= cut
        work += [(part[goes_left], depth + 1, at, 0), (part[~goes_left], depth + 1, at, 1)]
    return [tuple(n) for n in nodes]


def _steps(nodes: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays (depth, feature, cut, children, path length) in which a row takes ``depth`` steps: leaves lead to
    themselves."""
    own, leaf = np.arange(len(nodes)), nodes["feature"].to_numpy() < 0
    child = np.column_stack([np.where(leaf, own, nodes[side]) for side in ("left", "right")]).ravel().astype(np.int32)
    depth, reached = 0, np.zeros(1, np.int32)
    while not leaf[reached].all():
        depth, reached = depth + 1, np.unique(child.reshape(-1, 2)[reached])
    return (depth, np.where(leaf, 0, nodes["feature"]).astype(np.int32), np.where(leaf, np.inf, nodes["cut"]), child,
            nodes["path"].to_numpy(dtype=float))


def flag_by_isolation_forest(df: DataFrame, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE,
                             seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Outlier if the isolation score (in ``outlier_score``) is above ``threshold``.

    Each tree is grown on ``min(sample, n)`` rows of its own draw, as the method defines; all rows are scored.  Copies of a row are
    counted by a 64-bit hash of its values, so only hashes and counts are shuffled.  One hash decides in how many trees a
    value's copies are drawn together: their share, rounded up or down, from a first tree on in turn.  So the draw depends on
    the values alone, not on partitions or retries, and copies are drawn like any rows.  The values of the rows that are drawn,
    some ``trees * sample``, come from a second look at the columns.  Trees grow in parallel tasks, and the forest has at most
    2 * sample nodes per tree.
    """
    columns = list(columns)
    complete = df.select([as_number(c).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = complete.columns
    complete = complete.withColumn("__row", F.xxhash64(*names))
    counted = complete.groupBy("__row").agg(F.count(F.lit(1)).alias("__copies"))
    n = complete.count()
    # Six deviations more than the sample, so that no tree falls short of it.
    share = min(1.0, (sample + 6 * sample ** 0.5 + 10) / max(n, 1))
    unit = F.xxhash64(F.lit(seed), "__row") / float(1 << 64) + 0.5
    times = F.floor(F.col("__copies") * F.lit(share * trees) + unit).cast("long")
    first = F.pmod(F.xxhash64(F.lit(seed + 1), "__row"), F.lit(trees))
    turns = counted.select("__row", times.alias("__times"), first.alias("__first")).filter("__times > 0").select(
        "__row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1),
                                       lambda i: F.pmod(F.col("__first") + i, F.lit(trees)))).alias("tree"))
    drawn = stored(turns.groupBy("__row", "tree").agg(F.count(F.lit(1)).alias("times")), "forest-draw")
    # Bounded by the draw: trees * (sample + six deviations) rows at most.
    wanted = F.broadcast(drawn.select("__row").distinct())
    values = complete.join(wanted, "__row", "left_semi").groupBy("__row").agg(F.max(F.struct(*names)).alias("__x"))
    drawn = drawn.join(values, "__row").select(F.col("tree").cast("int").alias("tree"), "times", "__x.*")

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        part = part.sort_values(names)
        rows = np.repeat(part[names].to_numpy(dtype=float), part["times"].to_numpy(), axis=0)
        rows = rows[rng.permutation(len(rows))[:sample]]
        grown = _grow(rows, rng)
        return pd.DataFrame({"tree": int(key[0]), "n": len(rows), "node": range(len(grown)),
                             **{k: v for k, v in zip(("feature", "cut", "left", "right", "path"), zip(*grown))}})

    schema = "tree int, n int, node int, feature int, cut double, left int, right int, path double"
    nodes = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas()
    forest = [(int(g["n"].iloc[0]), *_steps(g.sort_values("node"))) for _, g in nodes.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        rows = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        flat, starts = rows.ravel(), np.arange(len(rows), dtype=np.int32) * rows.shape[1]
        total, expected = np.zeros(len(rows)), 0.0
        for n, depth, feature, cut, child, path in shared.value:
            at = np.zeros(len(rows), np.int32)
            for _ in range(depth):
                beyond = ~(flat[starts + feature[at]] <= cut[at])
                at = child[2 * at + beyond]
            total += path[at]
            expected += float(_average_path(n))
        return pd.Series(np.where(np.isnan(rows).any(axis=1), np.nan, 2.0 ** (-total / max(expected, 1e-12))))

    scored = spread(df).withColumn("outlier_score", score(*[as_number(c) for c in columns]))
    value = F.col("outlier_score")
    return scored.withColumn(FLAG, F.when(value.isNull() | F.isnan(value), F.lit(0))
                             .when(value > threshold, F.lit(-1)).otherwise(F.lit(1)))


def remove_outliers(flagged: DataFrame) -> DataFrame:
    """Drop the rows flagged as outliers; rows that could not be judged stay."""
    return flagged.filter(ref(FLAG) >= 0).drop(FLAG, "outlier_score")
