"""Two-dimensional view of the numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabloom.functions.columns import as_number, ref

NUMERIC_VECTOR = "initial_numerical_features"
PROJECTED = "pcaFeatures"


def _numeric_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kept = [ref(c) for c in df.columns if c not in columns]
    complete = df.select(*kept, *[as_number(c).alias(c) for c in columns]).dropna(subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol=NUMERIC_VECTOR).transform(complete)


def project_2d(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (*keep, pc1, pc2): the first two principal axes, or the raw columns if there are two.

    The sign of an axis is arbitrary; here its largest loading is positive.  Rows with a missing value
    have no projection and are left out.  The result is a table, so it can be stored or sampled.
    """
    columns = list(columns)
    kept = [ref(c) for c in keep]
    if len(columns) <= 2:
        second = as_number(columns[1]) if len(columns) == 2 else F.lit(0.0)
        return df.select(*kept, as_number(columns[0]).alias("pc1"), second.alias("pc2")).dropna(
            subset=["pc1", "pc2"])
    vectors = _numeric_vector(df.select(*{c: ref(c) for c in (*keep, *columns)}.values()), columns)
    model = PCA(k=2, inputCol=NUMERIC_VECTOR, outputCol=PROJECTED).fit(vectors)
    axes = model.pc.toArray()
    signs = [float(np.sign(axis[np.argmax(np.abs(axis))])) for axis in axes.T]
    scores = vector_to_array(F.col(PROJECTED))
    return model.transform(vectors).select(
        *kept, (scores[0] * signs[0]).alias("pc1"), (scores[1] * signs[1]).alias("pc2"))


def explained_variance(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Rows (component, explained): share of the variance on each principal axis."""
    vectors = _numeric_vector(df.select([ref(c) for c in columns]), columns)
    model = PCA(k=k, inputCol=NUMERIC_VECTOR, outputCol=PROJECTED).fit(vectors)
    return df.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())],
        "component int, explained double")
