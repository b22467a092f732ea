"""Scores of predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    Evaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.sql import DataFrame

CLASSIFICATION = "classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"
TASKS = (CLASSIFICATION, MULTICLASS, REGRESSION)

DEFAULT_METRIC = {CLASSIFICATION: "areaUnderROC", MULTICLASS: "f1", REGRESSION: "rmse"}


def make_evaluator(task: str, metric: str | None = None, label: str = "label",
                   prediction: str = "prediction", raw: str = "rawPrediction", exact: bool = False) -> Evaluator:
    """The evaluator of the task; ``metric`` None (or "None") means the task's default.

    ``exact`` keeps every distinct score of the ROC curve instead of a thousand bins.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    metric = DEFAULT_METRIC[task] if metric in (None, "None") else metric
    if task == CLASSIFICATION and metric in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName=metric,
                                             numBins=0 if exact else 1000)
    if task in (CLASSIFICATION, MULTICLASS):
        return MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)


@dataclass(frozen=True)
class Score:
    metric: str
    value: float
    larger_is_better: bool

    @property
    def signed(self) -> float:
        """Larger is always better; NaN is worst."""
        if self.value != self.value:
            return float("-inf")
        return self.value if self.larger_is_better else -self.value


def evaluate(predictions: DataFrame, evaluator: Evaluator) -> Score:
    return Score(evaluator.getMetricName(), float(evaluator.evaluate(predictions)), evaluator.isLargerBetter())
