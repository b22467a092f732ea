"""Queries of evaluation, learners, searches and whole runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators.assemble import FEATURES, STANDARDIZED, assembler, slot_map, standardizer
from tabloom.operators.evaluate import CLASSIFICATION, MULTICLASS, REGRESSION, evaluate, make_evaluator
from tabloom.operators.learners import LEARNERS, RACES, Setting
from tabloom.operators.partitions import spread
from tabloom.operators.scoring import LearnerScorer, MomentScorer, subset_scorer
from tabloom.operators.search import cross_validate, grid_scores, grid_search, param_grid, tune
from tabloom.operators.select import SubsetSearch
from tabloom.operators.split import hash_split, split_number
from tabloom.plans.automl import AutoML, AutoMLResult, Budget
from tabloom.plans.features import AutoFeatures
from tabloom.queries.inputs import (
    KEYS_SQL,
    LABELLED_SQL,
    LINE_KEYS,
    bucket_sql,
    labelled_lineitem,
    r6,
)
from tabloom.sources import results
from tabloom.sources.tables import load_table

# --- evaluation of a fixed prediction

_SCORE_SQL = "((l_quantity / 50 * 0.7 + l_discount * 3) / 2)"


def _classified(spark, sf) -> DataFrame:
    """The label, a score rounded so that it has ties, and the class it predicts."""
    score = F.round((F.col("l_quantity") / 50 * 0.7 + F.col("l_discount") * 3) / 2, 3)
    return labelled_lineitem(spark, sf).select(
        F.col("flagged").cast("double").alias("label"), score.alias("rawPrediction"),
        (score > 0.35).cast("double").alias("prediction"))


_CLASSIFIED = f"""{LABELLED_SQL},
  p AS (SELECT flagged AS y, round({_SCORE_SQL}, 3) AS s,
               CASE WHEN round({_SCORE_SQL}, 3) > 0.35 THEN 1 ELSE 0 END AS c FROM labelled)"""
_CONFUSION = f"""WITH {_CLASSIFIED},
  k AS (SELECT v, (count(*) FILTER (y = v AND c = v))::DOUBLE AS tp, (count(*) FILTER (y = v))::DOUBLE AS pos,
               (count(*) FILTER (c = v))::DOUBLE AS said, count(*)::DOUBLE AS n
        FROM p, (VALUES (0), (1)) AS t(v) GROUP BY v),
  r AS (SELECT tp, pos, n, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr,
               CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS re FROM k)"""


def _rated(task: str, metric: str, frame: Callable) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        score = evaluate(frame(spark, sf), make_evaluator(task, metric, exact=True))
        return spark.createDataFrame([(metric, score.value, score.larger_is_better)],
                                     "metric string, value double, larger_is_better boolean").select(
            "metric", r6("value"), "larger_is_better")
    return query


def _rated_sql(metric: str, expression: str, larger: bool, head: str, tail: str) -> str:
    return (f"{head} SELECT '{metric}' AS metric, round({expression}, 6) AS value, {str(larger).lower()} "
            f"AS larger_is_better {tail}")


_AUC = f"""WITH {_CLASSIFIED},
  g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM p GROUP BY s),
  t AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower FROM g)
  SELECT 'areaUnderROC' AS metric,
         round(sum(pos * (coalesce(lower, 0) + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS value,
         true AS larger_is_better FROM t"""

_AUPR = f"""WITH {_CLASSIFIED},
  g AS (SELECT s, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM p GROUP BY s),
  c AS (SELECT s, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS total
        FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT s, tp / total AS re, tp / said AS pr FROM c),
  d AS (SELECT re, pr, lag(re, 1, 0.0) OVER (ORDER BY s DESC) AS re0,
               coalesce(lag(pr) OVER (ORDER BY s DESC), pr) AS pr0 FROM e)
  SELECT 'areaUnderPR' AS metric, round(sum((re - re0) * (pr + pr0) / 2), 6) AS value, true AS larger_is_better FROM d"""


def _regressed(spark, sf) -> DataFrame:
    return labelled_lineitem(spark, sf).select(
        F.col("demand").alias("label"), (F.col("l_quantity") * 2.5 - F.col("l_discount") * 100 + 5).alias("prediction"))


_REGRESSED = f"""WITH {LABELLED_SQL},
  p AS (SELECT demand AS y, l_quantity * 2.5 - l_discount * 100 + 5 AS f FROM labelled),
  m AS (SELECT avg(y) AS mean FROM p)"""


# --- scores of fixed predictors, ranked

_PREDICTORS = {
    "mean_demand": ("(SELECT avg(demand) FROM labelled)", None),
    "quantity_only": ("l_quantity * 3", lambda: F.col("l_quantity") * 3),
    "quantity_and_discount": ("l_quantity * 3 - l_discount * 200", lambda: F.col("l_quantity") * 3 - F.col("l_discount") * 200),
}


def _board(spark, sf) -> DataFrame:
    df = labelled_lineitem(spark, sf)
    evaluator = make_evaluator(REGRESSION, "rmse", "demand")
    rows = []
    for name, (_, expression) in _PREDICTORS.items():
        prediction = F.lit(df.agg(F.avg("demand")).first()[0]) if expression is None else expression()
        score = evaluate(df.select("demand", prediction.alias("prediction")), evaluator)
        rows.append(results.leaderboard_row("fixed", name, score))
    return results.leaderboard(spark, rows).select("run_id", "algorithm", "metric", "larger_is_better", "score")


def ranked_scores(spark, sf) -> DataFrame:
    return results.ranked(_board(spark, sf)).withColumn("score", F.round("score", 6))


def best(spark, sf) -> DataFrame:
    return results.best_run(_board(spark, sf)).withColumn("score", F.round("score", 6))


_BOARD = f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"SELECT 'fixed' AS run_id, '{n}' AS algorithm, 'rmse' AS metric, false AS larger_is_better, "
    f"round(sqrt(avg((demand - ({e})) ** 2)), 6) AS score FROM labelled" for n, (e, _) in _PREDICTORS.items())


# --- learners

_INPUTS = ["l_quantity", "l_discount", "l_tax", "returned"]


def _vectors(spark, sf, label: str) -> tuple[DataFrame, DataFrame]:
    """Train and test frames of (features, label); the flag of returns is a number here."""
    df = labelled_lineitem(spark, sf).withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    frame = assembler(_INPUTS).transform(df).select(*LINE_KEYS, FEATURES, F.col(label).cast("double").alias("label"))
    train, test = (part.select(FEATURES, "label") for part in hash_split(frame, [0.8, 0.2], LINE_KEYS, seed=1, portable=True))
    return spread(train, bounded=True).persist(StorageLevel.MEMORY_AND_DISK), spread(test, bounded=True)


def _fit(name: str, task: str, **params) -> Callable:
    """Fit on the training rows; compare the learner with a constant predictor on the test rows."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        train, test = _vectors(spark, sf, "demand" if task == REGRESSION else "flagged")
        learner = LEARNERS[name]
        setting = Setting(width=len(_INPUTS), non_negative=True, features=STANDARDIZED if learner.scaled else FEATURES)
        try:
            n_train, mean = train.agg(F.count(F.lit(1)), F.avg("label")).first()
            stages = [standardizer(train)] if learner.scaled else []
            ready = PipelineModel(stages)
            model = learner.estimator(setting, **params).fit(ready.transform(train))
        finally:
            train.unpersist()
        constant = mean if task == REGRESSION else float(mean >= 0.5)
        metric = "rmse" if task == REGRESSION else "accuracy"
        evaluator = make_evaluator(task, metric)
        predictions = model.transform(ready.transform(test)).select("label", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            score = evaluate(predictions, evaluator)
            floor = evaluate(predictions.withColumn("prediction", F.lit(constant)), evaluator)
            n_test = predictions.count()
        finally:
            predictions.unpersist()
        return spark.createDataFrame(
            [(name, n_train, n_test, metric, floor.value, score.signed > floor.signed)],
            "learner string, n_train bigint, n_test bigint, metric string, constant_score double, beats_constant boolean",
        ).withColumn("constant_score", F.round("constant_score", 6))
    return query


def _fit_sql(name: str, task: str) -> str:
    label, metric, constant = ("demand", "rmse", "sqrt(avg((y - mean) ** 2))") if task == REGRESSION else (
        "flagged", "accuracy", "avg(CASE WHEN y = CASE WHEN mean >= 0.5 THEN 1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0 END)")
    return f"""WITH {LABELLED_SQL},
      parts AS (SELECT {label}::DOUBLE AS y, {bucket_sql(1, LINE_KEYS)} >= 800 AS held FROM labelled),
      m AS (SELECT avg(y) AS mean, count(*) AS n FROM parts WHERE NOT held)
      SELECT '{name}' AS learner, any_value(n) AS n_train, count(*) AS n_test, '{metric}' AS metric,
             round({constant}, 6) AS constant_score, true AS beats_constant FROM parts, m WHERE held"""


def _fitted(name: str, task: str) -> tuple[Callable, str]:
    return _fit(name, task), _fit_sql(name, task)


def _one_column(spark, sf) -> DataFrame:
    df = labelled_lineitem(spark, sf)
    return assembler(["l_quantity"]).transform(df).select(*LINE_KEYS, FEATURES, F.col("demand").alias("label"))


def _line(name: str) -> Callable:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        model = LEARNERS[name].estimator(Setting(width=1)).fit(_one_column(spark, sf))
        return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                     "slope double, intercept double").select(r6("slope"), r6("intercept"))
    return query


_LINE_SQL = f"""WITH {LABELLED_SQL}
  SELECT round(regr_slope(demand, l_quantity), 6) AS slope, round(regr_intercept(demand, l_quantity), 6) AS intercept
  FROM labelled"""


def predict_linear(spark, sf) -> DataFrame:
    df = _one_column(spark, sf)
    model = LEARNERS["linear_regression"].estimator(Setting(width=1)).fit(df)
    return model.transform(df).select(*LINE_KEYS, F.round("prediction", 5).alias("prediction"))


def naive_bayes(spark, sf) -> DataFrame:
    """Parameters of the Gaussian model: one row per class and column."""
    df = labelled_lineitem(spark, sf).withColumn("label", F.col("flagged").cast("double"))
    names = ["l_quantity", "l_discount", "l_tax"]
    model = LEARNERS["naive_bayes"].estimator(Setting(), modelType="gaussian").fit(assembler(names).transform(df))
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    rows = [(c, n, float(theta[c, i]), float(sigma[c, i]), float(model.pi[c]))
            for c in range(theta.shape[0]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "class int, feature string, mean double, variance double, log_prior double") \
        .select("class", "feature", r6("mean"), r6("variance"), r6("log_prior"))


_BAYES_SQL = f"""WITH {LABELLED_SQL},
  eps AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) AS e FROM labelled),
  n AS (SELECT count(*) AS total FROM labelled) """ + " UNION ALL ".join(
    f"""SELECT flagged::INTEGER AS class, '{c}' AS feature, round(avg({c}), 6) AS mean,
       round(var_pop({c}) + any_value(e), 6) AS variance, round(ln(count(*) / any_value(total)::DOUBLE), 6) AS log_prior
       FROM labelled, eps, n GROUP BY flagged""" for c in ("l_quantity", "l_discount", "l_tax"))


def multiclass(spark, sf) -> DataFrame:
    """Ten classes of embeddings: the race and naive Bayes, evaluated by F1 on held-out vectors."""
    df = load_table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias(FEATURES),
        F.col("label").cast("double").alias("label"))
    train, test = hash_split(df, [0.8, 0.2], ["vec_id"], seed=1)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    evaluator = make_evaluator(MULTICLASS, "f1")
    try:
        width = slot_map(train, [FEATURES]).width
        rows = []
        for name in (*RACES[MULTICLASS], "naive_bayes"):
            model = LEARNERS[name].estimator(Setting(width=width, classes=10)).fit(train)
            rows.append((name, evaluate(model.transform(test), evaluator).value))
    finally:
        train.unpersist()
    return spark.createDataFrame(rows, "learner string, f1 double")


# --- subset search

_CANDIDATES = ["l_tax", "l_quantity", "noise_a", "l_discount", "noise_b"]


def _candidates(spark, sf, label: str) -> DataFrame:
    df = labelled_lineitem(spark, sf).withColumns({
        "noise_a": F.pmod(F.xxhash64(*LINE_KEYS), F.lit(1000)) / 1000.0,
        "noise_b": F.pmod(F.xxhash64(F.lit(1), *LINE_KEYS), F.lit(1000)) / 1000.0})
    return assembler(_CANDIDATES).transform(df).select(*LINE_KEYS, FEATURES, F.col(label).cast("double").alias("label"))


def _search_frames(spark, sf, label: str, weights=(0.75, 0.25), seed: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The kept frame and its two parts; the number of the part is kept in place of the keys, so no pass hashes them again."""
    frame = _candidates(spark, sf, label).select(
        FEATURES, "label", split_number(weights, LINE_KEYS, seed, portable=True).alias("part"))
    frame = spread(frame, bounded=True).persist(StorageLevel.MEMORY_AND_DISK)
    return frame, *(frame.filter(F.col("part") == i) for i in (0, 1))


def _select(stabilised: bool) -> Callable:
    """What a search found: its metric, whether the chosen subset is the best of those tried, and of known columns."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        frame, train, validation = _search_frames(spark, sf, "flagged" if stabilised else "demand")
        try:
            slots = slot_map(frame, [FEATURES])
            slots = replace(slots, columns=tuple(_CANDIDATES), sizes=(1,) * len(_CANDIDATES))
            name, task = ("logistic_regression", CLASSIFICATION) if stabilised else ("linear_regression", REGRESSION)
            scorer = subset_scorer(train, validation, slots, LEARNERS[name], Setting(), task)
            search = SubsetSearch(_CANDIDATES, scorer, seed=5)
            found = search.stabilised_nrpa(2, 2, 3) if stabilised else search.nrpa(3, 3)
            n_validation = validation.count()
            if stabilised:
                scorer.close()
        finally:
            frame.unpersist()
        best = max(s.signed for s in found.tried.values())
        needed = {"l_quantity", "l_discount"}  # both labels depend on these
        return spark.createDataFrame(
            [(found.score.metric, found.score.signed == best, set(found.columns) <= set(_CANDIDATES),
              needed <= set(found.columns), n_validation)],
            "metric string, best_chosen boolean, known boolean, needed_kept boolean, n_validation bigint")
    return query


def _select_sql(metric: str) -> str:
    return f"""WITH {LABELLED_SQL} SELECT '{metric}' AS metric, true AS best_chosen, true AS known, true AS needed_kept,
      count(*) AS n_validation FROM labelled WHERE {bucket_sql(2, LINE_KEYS)} >= 750"""


def score_subset(spark, sf) -> DataFrame:
    """RMSE on the validation rows of least squares on single columns: by moments and by the learner."""
    frame, train, validation = _search_frames(spark, sf, "demand")
    try:
        slots = replace(slot_map(frame, [FEATURES]), columns=tuple(_CANDIDATES), sizes=(1,) * len(_CANDIDATES))
        moments = MomentScorer(train, validation, slots, Setting())
        learner = LearnerScorer(train, validation, slots, LEARNERS["linear_regression"], Setting(), REGRESSION)
        rows = [(c, moments([c]).value, learner([c]).value) for c in ("l_quantity", "l_discount", "l_tax")]
    finally:
        frame.unpersist()
    return spark.createDataFrame(rows, "subset string, rmse_moments double, rmse_learner double").select(
        "subset", F.round("rmse_moments", 5).alias("rmse_moments"), F.round("rmse_learner", 5).alias("rmse_learner"))


_SUBSET_SQL = f"""WITH {LABELLED_SQL}, parts AS (SELECT *, {bucket_sql(2, LINE_KEYS)} >= 750 AS held FROM labelled) """ + \
    " UNION ALL ".join(f"""SELECT '{c}' AS subset, round(sqrt(avg((demand - a - b * {c}) ** 2)), 5) AS rmse_moments,
      round(sqrt(avg((demand - a - b * {c}) ** 2)), 5) AS rmse_learner FROM parts,
      (SELECT regr_slope(demand, {c}) AS b, regr_intercept(demand, {c}) AS a FROM parts WHERE NOT held)
      WHERE held""" for c in ("l_quantity", "l_discount", "l_tax"))


# --- hyperparameters

def _trials(sampler: str) -> Callable:
    """Twelve trials: each inside the learner's space, and the chosen one the best of all."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        frame, train, validation = _search_frames(spark, sf, "flagged", (0.7, 0.3), 3)
        learner, setting = LEARNERS["logistic_regression"], Setting()
        try:
            tuned = tune(train, validation, learner, setting, make_evaluator(CLASSIFICATION), trials=12, sampler=sampler, seed=1)
            held = validation.count()
        finally:
            frame.unpersist()
        space = learner.space(setting)
        best = max(s.signed for _, s in tuned.trials)
        rows = [(i, all(d.low <= p[n] <= d.high for n, d in space.items()), tuned.score.signed == best, held)
                for i, (p, _) in enumerate(tuned.trials)]
        return spark.createDataFrame(rows, "trial int, in_space boolean, best_chosen boolean, n_validation bigint")
    return query


_TRIALS_SQL = f"""WITH {LABELLED_SQL}, held AS (SELECT count(*) AS n FROM labelled WHERE {bucket_sql(3, LINE_KEYS)} >= 700)
  SELECT unnest(range(12))::INTEGER AS trial, true AS in_space, true AS best_chosen, n AS n_validation FROM held"""


def cross_validation(spark, sf) -> DataFrame:
    """Mean RMSE over three folds of a line with and without intercept."""
    estimator = LEARNERS["linear_regression"].estimator(Setting(width=1))
    grid = param_grid(estimator, {"fitIntercept": [True, False]})
    model = cross_validate(_one_column(spark, sf), estimator, grid, make_evaluator(REGRESSION), LINE_KEYS, seed=4,
                           portable=True)
    rows = [(p.split("=")[1] == "True", s) for p, s in grid_scores(grid, model.avgMetrics)]
    return spark.createDataFrame(rows, "fit_intercept boolean, rmse double").select(
        "fit_intercept", F.round("rmse", 5).alias("rmse"))


_FOLD = f"(CASE WHEN {bucket_sql(4, LINE_KEYS)} >= 667 THEN 2 WHEN {bucket_sql(4, LINE_KEYS)} >= 333 THEN 1 ELSE 0 END)"
_FOLDS_SQL = f"""WITH {LABELLED_SQL}, parts AS (SELECT demand AS y, l_quantity AS x, {_FOLD} AS fold FROM labelled),
  fits AS (SELECT v.f AS held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum(x * y) / sum(x * x) AS origin
           FROM parts, (VALUES (0), (1), (2)) AS v(f) WHERE fold <> v.f GROUP BY v.f),
  errors AS (SELECT held, sqrt(avg((y - a - b * x) ** 2)) AS with_a, sqrt(avg((y - origin * x) ** 2)) AS without_a
             FROM parts JOIN fits ON fold = held GROUP BY held)
  SELECT true AS fit_intercept, round(avg(with_a), 5) AS rmse FROM errors
  UNION ALL SELECT false, round(avg(without_a), 5) FROM errors"""


def _grid(name: str, method: str = "single_split") -> Callable:
    """Search over the learner's own grid: the points, whether each has a score, and the rows of the last score."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        frame = _candidates(spark, sf, "flagged")
        setting = Setting(width=len(_CANDIDATES), non_negative=True)
        model, held_out = grid_search(frame, LEARNERS[name], setting, make_evaluator(MULTICLASS, "f1"), LINE_KEYS,
                                      method, portable=True)
        held = hash_split(frame, [0.8, 0.2], LINE_KEYS, 0, portable=True)[1].count()
        scores = model.validationMetrics if method == "single_split" else model.avgMetrics
        rows = grid_scores(model.getEstimatorParamMaps(), scores)
        return spark.createDataFrame([(p, 0 <= s <= 1 and 0 <= held_out.value <= 1, held) for p, s in rows],
                                     "params string, scored boolean, n_held_out bigint")
    return query


def _grid_sql(**lists: list) -> str:
    """Every combination of the lists, with names in order."""
    names = sorted(lists)
    tables = ", ".join(f"(VALUES {', '.join(f'({v!r})' if isinstance(v, str) else f'(' + repr(str(v)) + ')' for v in lists[n])}) "
                       f"AS t{i}(v{i})" for i, n in enumerate(names))
    text = " || ', ' || ".join(f"'{n}=' || v{i}" for i, n in enumerate(names))
    return f"""WITH {LABELLED_SQL}, held AS (SELECT count(*) AS n FROM labelled WHERE {bucket_sql(0, LINE_KEYS)} >= 800)
      SELECT {text} AS params, true AS scored, n AS n_held_out FROM held, {tables}"""


# --- whole runs

def _job(label: str, task: str, budget: Budget = Budget.of(3), **settings) -> AutoML:
    """A run of the whole race, with the budget and the polynomial degree of the library."""
    other = "demand" if label == "flagged" else "flagged"
    plan = AutoFeatures(label, ignore=(other, *LINE_KEYS), budget=budget.generation, seed=3)
    return AutoML(label, task, budget=budget, keys=tuple(LINE_KEYS), features=plan, seed=3, **settings)


def _whole(label: str, task: str) -> Callable:
    """What holds of a whole run's board, learner by learner."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = labelled_lineitem(spark, sf)
        df = df.drop("flagged", "demand") if task == MULTICLASS else df
        return _facts(_job(label, task).run(df))
    return query


def _facts(result: AutoMLResult) -> DataFrame:
    """A row for each learner: the metric, the trials, whether its features are columns of the frame, whether the board has it
    behind those with better scores, all rows of both sides, and why it failed if it did."""
    spark = result.frame.raw_train.sparkSession
    rows = result.frame.train.count() + result.frame.test.count()
    board = [r["algorithm"] for r in results.ranked(result.leaderboard()).collect()]
    order = sorted(result.runs, key=lambda r: -r.score.signed)
    known = set(result.frame.model.columns)
    found = [(r.learner.name, r.score.metric, r.score.larger_is_better, len(r.tuned.trials), set(r.selection.columns) <= known,
              order[board.index(r.learner.name)].score.signed == r.score.signed, rows, None) for r in result.runs]
    failed = [(n, None, None, 0, False, False, rows, why) for n, why in sorted(result.failures.items())]
    return spark.createDataFrame(found + failed, "algorithm string, metric string, larger_is_better boolean, trials int, "
                                 "known_features boolean, in_order boolean, n_rows bigint, failure string")


def _whole_sql(task: str, metric: str, larger: bool) -> str:
    return f"""WITH {LABELLED_SQL}, n AS (SELECT count(*) AS n_rows FROM labelled)
      SELECT algorithm, '{metric}' AS metric, {str(larger).lower()} AS larger_is_better, 12::INTEGER AS trials, true AS known_features,
             true AS in_order, n_rows, NULL::VARCHAR AS failure
      FROM n, (VALUES {", ".join(f"('{name}')" for name in RACES[task])}) AS t(algorithm)"""


def _board_of(result: AutoMLResult) -> DataFrame:
    """The learners by rank, then those that failed, with the reason."""
    board = results.ranked(result.leaderboard()).select(
        "algorithm", "metric", "larger_is_better", "score", F.array_join("features", ",").alias("features"),
        F.to_json("params").alias("params"), F.lit(None).cast("string").alias("failure"))
    return board.unionByName(_failures(board.sparkSession, result, "algorithm"), allowMissingColumns=True)


def _failures(spark: SparkSession, result: AutoMLResult, name: str) -> DataFrame:
    return spark.createDataFrame(sorted(result.failures.items()), f"{name} string, failure string")


def baseline_vs_tuned(spark, sf) -> DataFrame:
    """Each learner with its default and with its tuned parameters on the same features and test rows: F1 in its range."""
    result = _job("flagged", CLASSIFICATION, metric="f1", baseline=True).run(labelled_lineitem(spark, sf))
    rows = [(r.learner.name, model, score.metric, 0 <= score.value <= 1)
            for r in result.runs for model, score in (("baseline", r.plain), ("tuned", r.score))]
    return spark.createDataFrame(rows, "learner string, model string, metric string, in_range boolean") \
        .withColumn("failure", F.lit(None).cast("string")) \
        .unionByName(_failures(spark, result, "learner"), allowMissingColumns=True)


_BASELINE_SQL = f"""SELECT learner, model, 'f1' AS metric, true AS in_range, NULL::VARCHAR AS failure
  FROM (VALUES {", ".join(f"('{name}')" for name in RACES[CLASSIFICATION])}) AS t(learner), (VALUES ('baseline'), ('tuned')) AS m(model)"""


QUERIES = {
    "eval_auc_roc": (_rated(CLASSIFICATION, "areaUnderROC", _classified), _AUC),
    "eval_auc_pr": (_rated(CLASSIFICATION, "areaUnderPR", _classified), _AUPR),
    "eval_f1": (_rated(MULTICLASS, "f1", _classified), _rated_sql(
        "f1", "sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * pos / n)", True, _CONFUSION, "FROM r")),
    "eval_accuracy": (_rated(MULTICLASS, "accuracy", _classified), _rated_sql(
        "accuracy", "sum(tp) / max(n)", True, _CONFUSION, "FROM r")),
    "eval_weighted_precision": (_rated(MULTICLASS, "weightedPrecision", _classified), _rated_sql(
        "weightedPrecision", "sum(pr * pos / n)", True, _CONFUSION, "FROM r")),
    "eval_weighted_recall": (_rated(MULTICLASS, "weightedRecall", _classified), _rated_sql(
        "weightedRecall", "sum(re * pos / n)", True, _CONFUSION, "FROM r")),
    "eval_rmse": (_rated(REGRESSION, "rmse", _regressed), _rated_sql(
        "rmse", "sqrt(avg((y - f) ** 2))", False, _REGRESSED, "FROM p")),
    "eval_mse": (_rated(REGRESSION, "mse", _regressed), _rated_sql(
        "mse", "avg((y - f) ** 2)", False, _REGRESSED, "FROM p")),
    "eval_mae": (_rated(REGRESSION, "mae", _regressed), _rated_sql(
        "mae", "avg(abs(y - f))", False, _REGRESSED, "FROM p")),
    "eval_r2": (_rated(REGRESSION, "r2", _regressed), _rated_sql(
        "r2", "1 - sum((y - f) ** 2) / sum((y - mean) ** 2)", True, _REGRESSED, "FROM p, m")),
    "eval_var": (_rated(REGRESSION, "var", _regressed), _rated_sql(
        "var", "avg((f - mean) ** 2)", True, _REGRESSED, "FROM p, m")),
    "leaderboard": (ranked_scores, _BOARD),
    "best_run": (best, f"SELECT * FROM ({_BOARD}) ORDER BY score, algorithm LIMIT 1"),
    "fit_logistic_regression": _fitted("logistic_regression", CLASSIFICATION),
    "fit_random_forest": _fitted("random_forest", CLASSIFICATION),
    "fit_gbt_classifier": _fitted("gradient_boosted_trees", CLASSIFICATION),
    "fit_perceptron": _fitted("multilayer_perceptron", CLASSIFICATION),
    "fit_linear_svc": _fitted("linear_svc", CLASSIFICATION),
    "fit_fm_classifier": _fitted("factorization_machine", CLASSIFICATION),
    "fit_decision_tree": _fitted("decision_tree", CLASSIFICATION),
    "fit_naive_bayes": (naive_bayes, _BAYES_SQL),
    "fit_gbt_regressor": _fitted("gradient_boosted_regression", REGRESSION),
    "fit_fm_regressor": _fitted("factorization_machine_regression", REGRESSION),
    "fit_linear_regression": (_line("linear_regression"), _LINE_SQL),
    "fit_glm": (_line("generalized_linear_regression"), _LINE_SQL),
    "fit_multiclass": (multiclass, None),
    "predict_linear": (predict_linear, f"""WITH {LABELLED_SQL},
        m AS (SELECT regr_slope(demand, l_quantity) AS b, regr_intercept(demand, l_quantity) AS a FROM labelled)
        SELECT {KEYS_SQL}, round(a + b * l_quantity, 5) AS prediction FROM labelled, m"""),
    "score_subset": (score_subset, _SUBSET_SQL),
    "select_features_nrpa": (_select(False), _select_sql("rmse")),
    "select_features_snrpa": (_select(True), _select_sql("areaUnderROC")),
    "hpo_random": (_trials("random"), _TRIALS_SQL),
    "hpo_tpe": (_trials("tpe"), _TRIALS_SQL),
    "cross_validate": (cross_validation, _FOLDS_SQL),
    "cross_validate_grid": (_grid("logistic_regression", "cross_validation"), _grid_sql(
        regParam=[0.1, 0.01], elasticNetParam=[0.0, 1.0])),
    "train_validation_split": (_grid("decision_tree"), _grid_sql(maxDepth=[5, 10], impurity=["gini", "entropy"])),
    "param_grid": (_grid("naive_bayes"), _grid_sql(smoothing=[0.5, 1.0, 1.5], modelType=["multinomial", "gaussian"])),
    "automl_classification": (_whole("flagged", CLASSIFICATION), _whole_sql(CLASSIFICATION, "areaUnderROC", True)),
    "automl_regression": (_whole("demand", REGRESSION), _whole_sql(REGRESSION, "rmse", False)),
    "automl_multiclass": (_whole("l_returnflag", MULTICLASS), _whole_sql(MULTICLASS, "f1", True)),
    "baseline_vs_tuned": (baseline_vs_tuned, _BASELINE_SQL),
}
