"""Queries of imputation, encoding, vectors, outliers and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tabloom.operators import outliers
from tabloom.operators.assemble import assembler, normalizer, slicer, slot_map, standardizer
from tabloom.operators.encode import category_encoder, label_indexer, slot_indexer
from tabloom.operators.generate import GroupThen, PairArithmetic, QuantileBuckets, polynomial_names, polynomial_stages
from tabloom.operators.impute import MissingValueExpander
from tabloom.operators.partitions import spread, working_copy
from tabloom.operators.projection import project_2d
from tabloom.operators.roles import column_roles
from tabloom.operators.scratch import scratch_path
from tabloom.plans.features import AutoFeatures, used_columns
from tabloom.queries.inputs import (
    GAPS_SQL,
    KEYS_SQL,
    LINE_KEYS,
    LINE_NUMBERS,
    labelled_lineitem,
    lineitem,
    missing_text_sql,
    orders_with_gaps,
    r6,
)
from tabloom.sources import feature_store as store
from tabloom.sources.results import load_model, save_model
from tabloom.sources.tables import load_table


def _slots(vector: str, names: Sequence[str], digits: int = 6):
    """The slots of a vector as rounded columns."""
    values = vector_to_array(F.col(vector))
    return [F.round(values[i], digits).alias(name) for i, name in enumerate(names)]


# --- missing values

def _expanded(spark, sf, *columns: str) -> DataFrame:
    df = orders_with_gaps(spark, sf)
    return MissingValueExpander(inputCols=list(columns)).fit(df).transform(df)


def _imputed(strategy: str):
    def query(spark, sf) -> DataFrame:
        df = orders_with_gaps(spark, sf)
        model = MissingValueExpander(inputCols=["x"], strategies=[strategy]).fit(df)
        return model.transform(df).select("o_orderkey", r6(f"imputed_{strategy}_x"))
    return query


def _filled(name: str):
    return lambda spark, sf: _expanded(spark, sf, "k").select("o_orderkey", name)


def fill_missing(spark, sf) -> DataFrame:
    return _expanded(spark, sf, "x", "k").select(
        "o_orderkey", r6("imputed_mean_x"), r6("imputed_median_x"), r6("imputed_mode_x"),
        "most_common_k", "Unknown_filling_k")


_MODE_X = "(SELECT x FROM om WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)"
_MODE_K = f"(SELECT k FROM om WHERE NOT {missing_text_sql('k')} GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)"
_FILLS = {
    "imputed_mean_x": "round(coalesce(x, (SELECT avg(x) FROM om)), 6)",
    "imputed_median_x": "round(coalesce(x, (SELECT quantile_disc(x, 0.5) FROM om)), 6)",
    "imputed_mode_x": f"round(coalesce(x, {_MODE_X}), 6)",
    "most_common_k": f"CASE WHEN {missing_text_sql('k')} THEN {_MODE_K} ELSE k END",
    "Unknown_filling_k": f"CASE WHEN {missing_text_sql('k')} THEN 'Unknown' ELSE k END",
}


def _fill_sql(*names: str) -> str:
    return f"WITH {GAPS_SQL} SELECT o_orderkey, " + ", ".join(f"{_FILLS[n]} AS {n}" for n in names) + " FROM om"


# --- encodings

def _orders(spark, sf) -> DataFrame:
    return load_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def ordinal(spark, sf) -> DataFrame:
    df = _orders(spark, sf)
    names = ["o_orderstatus", "o_orderpriority"]
    return category_encoder(df, names).transform(df).select(
        "o_orderkey", *[F.col(f"ordinal_indexed_{c}").cast("int").alias(f"ordinal_indexed_{c}") for c in names])


def one_hot(spark, sf) -> DataFrame:
    df = _orders(spark, sf)
    return category_encoder(df, ["o_orderstatus"]).transform(df).select(
        "o_orderkey", *_slots("one_hot_encoded_o_orderstatus", ["slot_0", "slot_1", "slot_2"]))


def indexed_label(spark, sf) -> DataFrame:
    df = _orders(spark, sf)
    return label_indexer(df, "o_orderpriority").transform(df).select(
        "o_orderkey", F.col("indexedLabel").cast("int").alias("indexedLabel"))


def vector_index(spark, sf) -> DataFrame:
    df = assembler(["l_linenumber", "l_extendedprice"]).transform(lineitem(spark, sf, "l_extendedprice"))
    return slot_indexer(df, "features", "indexedFeatures").transform(df).select(
        *LINE_KEYS, *_slots("indexedFeatures", ["line_index", "price"]))


def _rank_sql(column: str) -> str:
    return (f"(SELECT {column} AS v, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS i "
            f"FROM orders GROUP BY {column})")


# --- buckets, powers and vectors


def discretize(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, *BUCKETED)
    buckets = QuantileBuckets(inputCols=BUCKETED, outputCols=[f"discretized_{c}" for c in BUCKETED]).fit(df)
    return buckets.transform(df).select(
        *LINE_KEYS, *[F.col(f"discretized_{c}").cast("int").alias(f"discretized_{c}") for c in BUCKETED])


def _bucket_sql(c: str) -> str:
    return f"(SELECT count(*) FROM splits_{c} s WHERE s.v <= {c})::INTEGER AS discretized_{c}"


def _splits_sql(c: str) -> str:
    return (f"splits_{c} AS (SELECT DISTINCT unnest(quantile_disc({c}, "
            f"[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS v FROM lineitem)")


BUCKETED = ["l_quantity", "l_extendedprice", "l_discount"]
POWERS = ["a", "a2", "a3", "b", "ab", "a2b", "b2", "ab2", "b3"]


def polynomial(spark, sf) -> DataFrame:
    names = ["l_quantity", "l_discount"]
    df = lineitem(spark, sf, *names)
    for stage in polynomial_stages(names):
        df = stage.transform(df)
    return df.select(*LINE_KEYS, *_slots(polynomial_names(names)[1], POWERS))


def _assembled(spark, sf) -> DataFrame:
    return assembler(LINE_NUMBERS).transform(lineitem(spark, sf, *LINE_NUMBERS))


def assembled(spark, sf) -> DataFrame:
    return _assembled(spark, sf).select(*LINE_KEYS, *_slots("features", ["f0", "f1", "f2", "f3"]))


def normalized(spark, sf) -> DataFrame:
    return normalizer().transform(_assembled(spark, sf)).select(
        *LINE_KEYS, *_slots("normFeatures", ["f0", "f1", "f2", "f3"], 9))


def standardized(spark, sf) -> DataFrame:
    df = _assembled(spark, sf)
    return standardizer(df).transform(df).select(*LINE_KEYS, *_slots("scaledFeatures", ["f0", "f1", "f2", "f3"]))


def sliced(spark, sf) -> DataFrame:
    """Keep l_quantity and the encoded l_returnflag of a vector of three columns."""
    df = lineitem(spark, sf, "l_quantity", "l_tax", "l_returnflag")
    df = category_encoder(df, ["l_returnflag"]).transform(df)
    columns = ["l_tax", "one_hot_encoded_l_returnflag", "l_quantity"]
    df = assembler(columns).transform(df)
    kept = slot_map(df, columns).slots_of(["l_quantity", "one_hot_encoded_l_returnflag"])
    return slicer(kept).transform(df).select(
        *LINE_KEYS, *_slots("selectedFeatures", ["flag_0", "flag_1", "flag_2", "quantity"]))


_FLAGS_SQL = """(SELECT l_returnflag AS v, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS i
  FROM lineitem GROUP BY l_returnflag)"""


# --- outliers

_WIDE = ["l_extendedprice", "l_quantity"]


def iqr(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, *_WIDE).withColumn("spread", F.col("l_extendedprice") / (F.col("l_quantity") + 1))
    return outliers.flag_by_iqr(df, ["l_extendedprice", "spread"]).select(*LINE_KEYS, "outlier")


def zscore(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, *_WIDE).withColumn("spread", F.col("l_extendedprice") / (F.col("l_quantity") + 1))
    return outliers.flag_by_zscore(df, ["l_extendedprice", "spread"]).select(*LINE_KEYS, "outlier")


def removed(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, *_WIDE).withColumn("spread", F.col("l_extendedprice") / (F.col("l_quantity") + 1))
    return outliers.remove_outliers(outliers.flag_by_iqr(df, ["l_extendedprice", "spread"])).select(*LINE_KEYS)


def isolation(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, *LINE_NUMBERS)
    return outliers.flag_by_isolation_forest(df, LINE_NUMBERS).select(*LINE_KEYS, "outlier", r6("outlier_score"))


def projection(spark, sf) -> DataFrame:
    return project_2d(lineitem(spark, sf, *LINE_NUMBERS, "l_returnflag"), LINE_NUMBERS,
                      [*LINE_KEYS, "l_returnflag"])


_SPREAD = "s AS (SELECT *, l_extendedprice / (l_quantity + 1) AS spread FROM lineitem)"


def _fence(c: str) -> str:
    return f"{c} BETWEEN q.{c}1 - 1.5 * (q.{c}3 - q.{c}1) AND q.{c}3 + 1.5 * (q.{c}3 - q.{c}1)"


_IQR = f"""WITH {_SPREAD},
  q AS (SELECT {', '.join(f'quantile_cont({c}, 0.{p}) AS {c}{n}'
                          for c in ('l_extendedprice', 'spread') for p, n in ((25, 1), (75, 3)))} FROM s)"""


# --- stored tables

def definitions(spark, sf) -> DataFrame:
    """Definitions of a group made of two raw and the generated features, with the rows behind them."""
    orders = load_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    frame = PairArithmetic(pairs=[("o_totalprice", "o_custkey")]).transform(orders)
    chosen = ["o_orderstatus", "o_custkey", "multiplied_o_totalprice_o_custkey"]
    rows = frame.select(chosen).agg(*[F.count(c).alias(c) for c in chosen]).first().asDict()
    listed = store.feature_definitions(frame, chosen, "ordersID")
    return spark.createDataFrame([(i, n, t, rows.get(n)) for i, (n, t) in enumerate(listed)],
                                 "position int, feature string, type string, n_present bigint")


def _event_rows(spark, sf) -> DataFrame:
    events = load_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return store.feature_rows(events, ["event_id", "event_type", "value"], F.col("user_id"),
                              F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "eventsID")


def offline(spark, sf) -> DataFrame:
    """Write the group, read it back."""
    root = scratch_path(spark, "store")
    store.write_feature_group(_event_rows(spark, sf), root, "events")
    return store.read_feature_group(spark, root, "events").select(
        "eventsID", "EventTime", "event_id", "event_type", "value")


def rerun(spark, sf) -> DataFrame:
    """Two runs that share a group, each written twice: every run's rows are there once."""
    root, rows = scratch_path(spark, "store"), _event_rows(spark, sf)
    for run, part in (("a", rows.filter("event_id % 2 = 0")), ("b", rows.filter("event_id % 2 = 1"))) * 2:
        store.write_feature_group(part, root, "events", run)
    return store.read_feature_group(spark, root, "events").select(
        "eventsID", "EventTime", "event_id", "event_type", "value")


def upserted(spark, sf) -> DataFrame:
    """The latest rows after merging a part of the events, then all, then all again."""
    root, rows = scratch_path(spark, "store"), _event_rows(spark, sf)
    for part in (rows.filter("event_id % 3 = 0"), rows, rows):
        store.upsert_latest(part, root, "events", "eventsID", tie_break=["event_id"])
    return store.read_latest(spark, root, "events").select("eventsID", "EventTime", "event_id", "event_type", "value")


def latest(spark, sf) -> DataFrame:
    return store.latest_rows(_event_rows(spark, sf), "eventsID", tie_break=["event_id"]).select(
        "eventsID", "EventTime", "event_id", "event_type", "value")


_EVENTS = "CAST(user_id AS VARCHAR) AS eventsID, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS EventTime"


_LATEST_SQL = f"""SELECT {_EVENTS}, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def roundtrip(spark, sf) -> DataFrame:
    """Save and load a fitted chain of our own and built-in stages; compare every transformed row."""
    df = orders_with_gaps(spark, sf)
    expander = MissingValueExpander(inputCols=["x", "k"]).fit(df)
    frame = expander.transform(df)
    group = GroupThen(by="most_common_k", values=["imputed_mean_x"]).fit(frame)
    encoder = category_encoder(group.transform(frame), ["Unknown_filling_k"])
    columns = ["imputed_mean_x", "imputed_median_x", "one_hot_encoded_Unknown_filling_k", *group.outputs()]
    model = PipelineModel([expander, group, *encoder.stages, assembler(columns)])
    loaded = load_model(save_model(model, scratch_path(spark, "model")))
    before, after = (m.transform(df).select("o_orderkey", vector_to_array("features").alias(name))
                     for m, name in ((model, "saved"), (loaded, "loaded")))
    return before.join(after, "o_orderkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("saved") == F.col("loaded")).alias("n_equal"))


# --- the whole feature frame

def feature_columns(spark, sf) -> DataFrame:
    """Every feature column of the frame with its slots and how many rows it fills."""
    df, model = _auto(spark, sf)
    frame = model.transform(df).agg(F.count("features").alias("n")).first()
    rows = [(c, model.slots.slots(c).start, len(model.slots.slots(c)), frame["n"]) for c in model.columns]
    return spark.createDataFrame(rows, "feature string, first_slot int, n_slots int, n_rows bigint")


def _auto(spark, sf):
    df = labelled_lineitem(spark, sf)
    plan = AutoFeatures("flagged", ignore=("demand", *LINE_KEYS), budget=2, seed=3)
    roles = column_roles(df, "flagged").without(plan.ignore)
    df = used_columns(df, [*LINE_KEYS, "flagged", *roles.numeric, *roles.categorical])
    # No statistic is learned from the keys, so the copy that the fit reads goes without them.
    with working_copy(df.drop(*LINE_KEYS)) as rows:
        return spread(df), plan.fit(rows)


def auto_features(spark, sf) -> DataFrame:
    df, model = _auto(spark, sf)
    return model.transform(df).select(*LINE_KEYS, "flagged", vector_to_array("features").alias("features"))


QUERIES = {
    "impute_mean": (_imputed("mean"), _fill_sql("imputed_mean_x")),
    "impute_median": (_imputed("median"), _fill_sql("imputed_median_x")),
    "impute_mode": (_imputed("mode"), _fill_sql("imputed_mode_x")),
    "impute_most_common": (_filled("most_common_k"), _fill_sql("most_common_k")),
    "impute_unknown": (_filled("Unknown_filling_k"), _fill_sql("Unknown_filling_k")),
    "fill_missing": (fill_missing, _fill_sql(*_FILLS)),
    "ordinal_encode": (ordinal, f"""
        SELECT o_orderkey, s.i::INTEGER AS ordinal_indexed_o_orderstatus, p.i::INTEGER AS ordinal_indexed_o_orderpriority
        FROM orders JOIN {_rank_sql('o_orderstatus')} s ON o_orderstatus = s.v
                    JOIN {_rank_sql('o_orderpriority')} p ON o_orderpriority = p.v"""),
    "one_hot_encode": (one_hot, f"""
        SELECT o_orderkey, {', '.join(f'(s.i = {i})::INTEGER::DOUBLE AS slot_{i}' for i in range(3))}
        FROM orders JOIN {_rank_sql('o_orderstatus')} s ON o_orderstatus = s.v"""),
    "label_index": (indexed_label, f"""
        SELECT o_orderkey, p.i::INTEGER AS "indexedLabel"
        FROM orders JOIN {_rank_sql('o_orderpriority')} p ON o_orderpriority = p.v"""),
    "vector_index": (vector_index, f"""
        SELECT {KEYS_SQL}, (dense_rank() OVER (ORDER BY l_linenumber) - 1)::DOUBLE AS line_index,
               round(l_extendedprice, 6) AS price FROM lineitem"""),
    "discretize": (discretize, f"""WITH {', '.join(_splits_sql(c) for c in BUCKETED)}
        SELECT {KEYS_SQL}, {', '.join(_bucket_sql(c) for c in BUCKETED)} FROM lineitem"""),
    "polynomial_expand": (polynomial, f"""
        WITH p AS (SELECT {KEYS_SQL}, l_quantity AS a, l_discount AS b FROM lineitem)
        SELECT {KEYS_SQL}, round(a, 6) AS a, round(a * a, 6) AS a2, round(a * a * a, 6) AS a3, round(b, 6) AS b,
               round(a * b, 6) AS ab, round(a * a * b, 6) AS a2b, round(b * b, 6) AS b2, round(a * b * b, 6) AS ab2,
               round(b * b * b, 6) AS b3 FROM p"""),
    "assemble_features": (assembled, f"""SELECT {KEYS_SQL},
        {', '.join(f'round({c}, 6) AS f{i}' for i, c in enumerate(LINE_NUMBERS))} FROM lineitem"""),
    "normalize_l1": (normalized, f"""SELECT {KEYS_SQL},
        {', '.join(f'round({c} / ({" + ".join(f"abs({d})" for d in LINE_NUMBERS)}), 9) AS f{i}'
                   for i, c in enumerate(LINE_NUMBERS))} FROM lineitem"""),
    "standardize": (standardized, f"""SELECT {KEYS_SQL},
        {', '.join(f'round({c} / (SELECT stddev_samp({c}) FROM lineitem), 6) AS f{i}'
                   for i, c in enumerate(LINE_NUMBERS))} FROM lineitem"""),
    "slice_features": (sliced, f"""
        SELECT {KEYS_SQL}, {', '.join(f'(f.i = {i})::INTEGER::DOUBLE AS flag_{i}' for i in range(3))},
               round(l_quantity, 6) AS quantity FROM lineitem JOIN {_FLAGS_SQL} f ON l_returnflag = f.v"""),
    "outliers_iqr": (iqr, f"""{_IQR}
        SELECT {KEYS_SQL}, CASE WHEN {_fence('l_extendedprice')} AND {_fence('spread')} THEN 1 ELSE -1 END AS outlier
        FROM s, q"""),
    "outliers_zscore": (zscore, f"""WITH {_SPREAD},
        m AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS b, avg(spread) AS c,
                     stddev_samp(spread) AS d FROM s)
        SELECT {KEYS_SQL}, CASE WHEN abs(l_extendedprice - a) <= 3 * b AND abs(spread - c) <= 3 * d
                                THEN 1 ELSE -1 END AS outlier FROM s, m"""),
    "outliers_removed": (removed, f"""{_IQR}
        SELECT {KEYS_SQL} FROM s, q WHERE {_fence('l_extendedprice')} AND {_fence('spread')}"""),
    "outliers_isolation_forest": (isolation, None),
    "pca_projection": (projection, None),
    "feature_definitions": (definitions, """
        SELECT 0::INTEGER AS position, 'o_custkey' AS feature, 'Integral' AS type, count(o_custkey) AS n_present FROM orders
        UNION ALL SELECT 1, 'o_orderstatus', 'String', count(o_orderstatus) FROM orders
        UNION ALL SELECT 2, 'multiplied_o_totalprice_o_custkey', 'Fractional', count(o_totalprice * o_custkey) FROM orders
        UNION ALL SELECT 3, 'ordersID', 'String', NULL UNION ALL SELECT 4, 'EventTime', 'String', NULL"""),
    "feature_group_offline": (offline, f"SELECT {_EVENTS}, event_id, event_type, value FROM events"),
    "feature_group_latest": (latest, _LATEST_SQL),
    "feature_group_rerun": (rerun, f"SELECT {_EVENTS}, event_id, event_type, value FROM events"),
    "feature_group_upsert": (upserted, _LATEST_SQL),
    "model_roundtrip": (roundtrip, "SELECT count(*) AS n_rows, count(*) AS n_equal FROM orders"),
    "feature_columns": (feature_columns, None),
    "auto_features": (auto_features, None),
}
