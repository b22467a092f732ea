"""The registered whole runs: nothing is left out, and failures are shown."""

from __future__ import annotations

from types import SimpleNamespace

from tabloom.operators.evaluate import CLASSIFICATION, MULTICLASS, REGRESSION, Score
from tabloom.operators.learners import RACES
from tabloom.plans.automl import AutoMLResult, Budget
from tabloom.queries import learning


def test_jobs_have_the_whole_budget(monkeypatch):
    for label, task in (("flagged", CLASSIFICATION), ("demand", REGRESSION)):
        job = learning._job(label, task)
        assert job.budget == Budget.of(3) == Budget() and job.learners == ()
        assert (job.features.degree, job.features.budget) == (3, 3)
    ran = []
    monkeypatch.setattr(learning.AutoML, "run", lambda self, df: ran.append(self))
    monkeypatch.setattr(learning, "_facts", lambda result: None)
    monkeypatch.setattr(learning, "labelled_lineitem", lambda spark, sf: SimpleNamespace(drop=lambda *names: None))
    for name in ("automl_classification", "automl_regression", "automl_multiclass"):
        learning.QUERIES[name][0](None, "")
    assert all(job.learners == () and job.budget == Budget.of(3) for job in ran) and len(ran) == 3


def test_failures_are_rows_of_the_board(spark):
    run = SimpleNamespace(learner=SimpleNamespace(name="linear_regression"), score=Score("rmse", 1.0, False),
                          selection=SimpleNamespace(columns=["x"]), tuned=SimpleNamespace(params={}))
    frame = SimpleNamespace(raw_train=spark.range(1))
    result = AutoMLResult(SimpleNamespace(model_root=None), frame, [run], failures={"generalized_linear_regression": "ValueError: x"})
    got = {r["algorithm"]: (r["score"], r["failure"]) for r in learning._board_of(result).collect()}
    assert got == {"linear_regression": (1.0, None), "generalized_linear_regression": (None, "ValueError: x")}
    assert set(RACES[MULTICLASS]) == {"logistic_regression", "random_forest", "multilayer_perceptron"}
