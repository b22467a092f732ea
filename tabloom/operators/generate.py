"""Generated features: pair arithmetic, group statistics, buckets and powers."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import Bucketizer, PolynomialExpansion, VectorAssembler, VectorSizeHint
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.arithmetic import pair_expressions
from tabloom.functions.columns import as_number, as_text, ref
from tabloom.operators import keyed
from tabloom.operators.quantiles import exact_quantiles
from tabloom.operators.stages import TableModel


class PairArithmetic(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Sum, both differences, product and both safe quotients of each pair, as one projection."""

    pairs = Param(Params._dummy(), "pairs", "Pairs of numeric columns.", TypeConverters.identity)

    @keyword_only
    def __init__(self, *, pairs=None):
        super().__init__()
        if pairs is not None:
            self._set(pairs=[list(p) for p in pairs])

    def outputs(self) -> list[str]:
        return list(dict.fromkeys(name for a, b in self.getOrDefault(self.pairs)
                                  for name in pair_expressions(a, b)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = {}
        for a, b in self.getOrDefault(self.pairs):
            made.update(pair_expressions(a, b))
        return dataset.select("*", *[expression.alias(name) for name, expression in made.items()])


GROUP_STATISTICS = {"min": F.min, "max": F.max, "avg": F.avg}


class _GroupParams(Params):
    by = Param(Params._dummy(), "by", "Categorical key column.", TypeConverters.toString)
    values = Param(Params._dummy(), "values", "Numeric columns.", TypeConverters.toListString)


class GroupThen(Estimator, _GroupParams, DefaultParamsReadable, DefaultParamsWritable):
    """Minimum, maximum and average of numeric columns by a key, and the group size.

    All columns that share the key are aggregated together.  The statistics belong to the fitted rows;
    rows with a NULL key form a group of their own.
    """

    @keyword_only
    def __init__(self, *, by=None, values=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "GroupThenModel":
        by, values = self.getOrDefault(self.by), self.getOrDefault(self.values)
        frame = dataset.select(as_text(by).alias("key"), *[as_number(v).alias(f"v{i}") for i, v in enumerate(values)])
        grouped = frame.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"),
            F.lit(1.0).alias("seen"),
            *[make(f"v{i}").alias(f"{s}{i}") for i in range(len(values)) for s, make in GROUP_STATISTICS.items()],
            *[F.sum(f"v{i}").alias(f"sum{i}") for i in range(len(values))],
            *[F.count(f"v{i}").alias(f"present{i}") for i in range(len(values))])
        lookup = keyed.measure(grouped, "key")
        # The whole table's statistics, for keys that new rows bring.
        total = lookup.frame.agg(*[
            e for i in range(len(values)) for e in (
                F.min(f"min{i}").alias(f"min{i}"), F.max(f"max{i}").alias(f"max{i}"),
                F.when(F.sum(f"present{i}") > 0, F.sum(f"sum{i}") / F.sum(f"present{i}")).alias(f"avg{i}"))]).first()
        lookup.frame = lookup.frame.drop(*[f"{p}{i}" for i in range(len(values)) for p in ("sum", "present")])
        model = GroupThenModel()
        model._set(by=by, values=values, fallback=total.asDict())
        model._hold({"groups": lookup})
        return model


class GroupThenModel(TableModel, _GroupParams):
    fallback = Param(Params._dummy(), "fallback", "Statistics for unseen keys.", TypeConverters.identity)

    def outputs(self) -> list[str]:
        by = self.getOrDefault(self.by)
        return [*[f"group_by_{by}_{s}_{v}" for v in self.getOrDefault(self.values) for s in GROUP_STATISTICS],
                f"group_by_{by}_count"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        by, values = self.getOrDefault(self.by), self.getOrDefault(self.values)
        fallback = self.getOrDefault(self.fallback)
        names = {f"{s}{i}": f"group_by_{by}_{s}_{v}" for i, v in enumerate(values) for s in GROUP_STATISTICS}
        attached = keyed.attach(dataset.withColumn("__by", as_text(by)), self.lookups["groups"], on="__by")
        unseen = ref("seen").isNull()
        return attached.select(
            *[ref(c) for c in dataset.columns],
            *[F.when(unseen, F.lit(fallback[short])).otherwise(ref(short)).cast("double").alias(name)
              for short, name in names.items()],
            F.coalesce(ref("n"), F.lit(0)).alias(f"group_by_{by}_count"))


class QuantileBuckets(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact equal-frequency buckets; the fitted stage is a bucketizer.  Equal boundaries are merged."""

    buckets = Param(Params._dummy(), "buckets", "Number of buckets asked for.", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, buckets=10):
        super().__init__()
        self._setDefault(buckets=10)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> Bucketizer:
        columns, k = list(self.getInputCols()), self.getOrDefault(self.buckets)
        inner = exact_quantiles(dataset, columns, [i / k for i in range(1, k)])
        edges = [[-math.inf, *sorted({x for x in inner[c] if x is not None}), math.inf] for c in columns]
        # A bucketizer wants three boundaries at least.
        edges = [e if len(e) > 2 else [-math.inf, 0.0, math.inf] for e in edges]
        return Bucketizer(splitsArray=edges, inputCols=columns, outputCols=list(self.getOutputCols()),
                          handleInvalid="keep")


def polynomial_slots(columns: int, degree: int = 3) -> int:
    return math.comb(columns + degree, degree) - 1


def polynomial_names(columns: Sequence[str]) -> tuple[str, str]:
    """Names of the assembled and the expanded vector column."""
    joined = "_".join(columns)
    return f"vectorized_{joined}", f"feature_polynomially_expanded_{joined}"


def polynomial_stages(columns: Sequence[str], degree: int = 3) -> list[Transformer]:
    """Assemble the columns and expand them to all monomials up to ``degree``."""
    slots = polynomial_slots(len(columns), degree)
    vector, expanded = polynomial_names(columns)
    return [VectorAssembler(inputCols=list(columns), outputCol=vector, handleInvalid="keep"),
            PolynomialExpansion(degree=degree, inputCol=vector, outputCol=expanded),
            # States the width in the schema, so that later stages need not look at a row.
            VectorSizeHint(inputCol=expanded, size=slots, handleInvalid="optimistic")]


@dataclass(frozen=True)
class FeatureSpecs:
    """What to generate: column pairs, and (key, value) combinations."""

    pairs: tuple[tuple[str, str], ...] = ()
    groups: tuple[tuple[str, str], ...] = ()

    def grouped(self) -> dict[str, list[str]]:
        """Value columns by key, so that each key is aggregated and joined once."""
        by: dict[str, list[str]] = {}
        for key, value in self.groups:
            by.setdefault(key, []).append(value)
        return by


def draw_specs(numeric: Sequence[str], categorical: Sequence[str], budget: int, seed: int = 0) -> FeatureSpecs:
    """``budget`` random draws, each a pair of two numeric columns or a key with a numeric column.

    Draws are distinct; when everything possible has been drawn, fewer are returned.
    """
    rng = random.Random(seed)
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1:]]
    groups = [(k, v) for k in categorical for v in numeric]
    rng.shuffle(pairs)
    rng.shuffle(groups)
    chosen_pairs, chosen_groups = [], []
    for _ in range(budget):
        kinds = [pool for pool in (pairs, groups) if pool]
        if not kinds:
            break
        pool = rng.choice(kinds)
        (chosen_pairs if pool is pairs else chosen_groups).append(pool.pop())
    return FeatureSpecs(tuple(chosen_pairs), tuple(chosen_groups))


def fit_specs(df: DataFrame, specs: FeatureSpecs) -> list[Transformer]:
    """Fitted stages that make the features of ``specs``; they read the original columns only."""
    stages: list[Transformer] = []
    if specs.pairs:
        stages.append(PairArithmetic(pairs=specs.pairs))
    for key, values in specs.grouped().items():
        stages.append(GroupThen(by=key, values=values).fit(df))
    return stages
