"""Queries of projections, splits and generated features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.arithmetic import pair_expressions
from tabloom.functions.text import remove_non_word_characters
from tabloom.operators.encode import limit_cardinality
from tabloom.operators.generate import FeatureSpecs, GroupThen, PairArithmetic, fit_specs
from tabloom.operators.split import hash_split
from tabloom.queries.inputs import GAPS_SQL, KEYS_SQL, LINE_KEYS, bucket_sql, lineitem, orders_with_gaps, r6
from tabloom.sources.feature_store import add_id
from tabloom.sources.tables import load_table

A, B = "l_extendedprice", "l_discount"
_ARITHMETIC_SQL = {
    f"sum_{A}_{B}": f"{A} + {B}",
    f"difference_{A}_{B}": f"{A} - {B}",
    f"difference_{B}_{A}": f"{B} - {A}",
    f"multiplied_{A}_{B}": f"{A} * {B}",
    f"division_{A}_{B}": f"CASE WHEN {B} <> 0 THEN {A} / {B} ELSE 0 END",
    f"division_{B}_{A}": f"CASE WHEN {A} <> 0 THEN {B} / {A} ELSE 0 END",
}


def _arithmetic(*prefixes: str):
    names = [n for n in _ARITHMETIC_SQL if n.startswith(prefixes)]

    def query(spark, sf) -> DataFrame:
        made = pair_expressions(A, B)
        return lineitem(spark, sf, A, B).select(*LINE_KEYS, *[made[n].alias(n) for n in names])

    sql = ", ".join(f"{_ARITHMETIC_SQL[n]} AS {n}" for n in names)
    return query, f"SELECT {KEYS_SQL}, {sql} FROM lineitem"


def arithmetic_features(spark, sf) -> DataFrame:
    stage = PairArithmetic(pairs=[(A, B)])
    return stage.transform(lineitem(spark, sf, A, B)).select(*LINE_KEYS, *stage.outputs())


def clean_text(spark, sf) -> DataFrame:
    return load_table(spark, sf, "documents", ["doc_id", "text"]).select(
        "doc_id", remove_non_word_characters("text").alias("clean_text"))


def split_rows(spark, sf) -> DataFrame:
    parts = hash_split(load_table(spark, sf, "orders", ["o_orderkey"]), [0.8, 0.2], ["o_orderkey"], seed=7,
                       portable=True)
    train, test = (p.withColumn("part", F.lit(name)) for p, name in zip(parts, ("train", "test")))
    return train.unionByName(test)


def row_ids(spark, sf) -> DataFrame:
    return add_id(load_table(spark, sf, "orders", ["o_orderkey"])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        (F.min("id") >= 0).alias("non_negative"))


def _group(key: str, value: str, *statistics: str):
    names = [f"group_by_{key}_{s}_{value}" if s != "count" else f"group_by_{key}_count" for s in statistics]

    def query(spark, sf) -> DataFrame:
        df = load_table(spark, sf, "orders", ["o_orderkey", key, value])
        return GroupThen(by=key, values=[value]).fit(df).transform(df).select(
            "o_orderkey", *[r6(n) if not n.endswith("_count") else n for n in names])

    cells = ", ".join(
        f"count(*) OVER (PARTITION BY {key}) AS {n}" if s == "count"
        else f"round({s}({value}) OVER (PARTITION BY {key}), 6) AS {n}" for s, n in zip(statistics, names))
    return query, f"SELECT o_orderkey, {cells} FROM orders"


def group_by_then(spark, sf) -> DataFrame:
    df = orders_with_gaps(spark, sf)
    model = GroupThen(by="k", values=["x"]).fit(df)
    return model.transform(df).select("o_orderkey", "k", *[r6(n) for n in model.outputs()[:-1]], "group_by_k_count")


SPECS = FeatureSpecs(
    pairs=(("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax")),
    groups=(("l_returnflag", "l_tax"), ("l_returnflag", "l_quantity"), ("l_linestatus", "l_discount")))


def generated(spark, sf) -> DataFrame:
    df = lineitem(spark, sf, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    start = set(df.columns)
    result = df
    for stage in fit_specs(df, SPECS):
        result = stage.transform(result)
    made = [c for c in result.columns if c not in start]
    return result.select(*LINE_KEYS, *[r6(c) if "_avg_" in c else c for c in made])


def _generated_sql() -> str:
    cells = []
    for a, b in SPECS.pairs:
        cells += [f"{a} + {b} AS sum_{a}_{b}", f"{a} - {b} AS difference_{a}_{b}",
                  f"{b} - {a} AS difference_{b}_{a}", f"{a} * {b} AS multiplied_{a}_{b}",
                  f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE 0 END AS division_{a}_{b}",
                  f"CASE WHEN {a} <> 0 THEN {b} / {a} ELSE 0 END AS division_{b}_{a}"]
    for key, values in SPECS.grouped().items():
        cells += [f"{s}({v}) OVER (PARTITION BY {key}) AS group_by_{key}_{s}_{v}"
                  for v in values for s in ("min", "max")]
        cells += [f"round(avg({v}) OVER (PARTITION BY {key}), 6) AS group_by_{key}_avg_{v}" for v in values]
        cells.append(f"count(*) OVER (PARTITION BY {key}) AS group_by_{key}_count")
    return f"SELECT {KEYS_SQL}, {', '.join(cells)} FROM lineitem"


def capped(spark, sf) -> DataFrame:
    part = load_table(spark, sf, "part", ["p_partkey", "p_brand"])
    return limit_cardinality(part, ["p_brand"], n=5)


QUERIES = {
    "arith_sum": _arithmetic("sum"),
    "arith_difference": _arithmetic("difference"),
    "arith_product": _arithmetic("multiplied"),
    "arith_division": _arithmetic("division"),
    "arithmetic_features": (arithmetic_features, _arithmetic("")[1]),
    "remove_non_word_characters": (clean_text, r"""
        SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]+', '', 'g') AS clean_text FROM documents"""),
    "hash_split": (split_rows, f"""
        SELECT o_orderkey, CASE WHEN {bucket_sql(7, ['o_orderkey'])} >= 800 THEN 'test' ELSE 'train' END AS part
        FROM orders"""),
    "add_id": (row_ids, "SELECT count(*) AS n_rows, count(*) AS n_ids, true AS non_negative FROM orders"),
    "group_by_then": (group_by_then, f"""WITH {GAPS_SQL}
        SELECT o_orderkey, k, round(min(x) OVER g, 6) AS group_by_k_min_x, round(max(x) OVER g, 6) AS group_by_k_max_x,
               round(avg(x) OVER g, 6) AS group_by_k_avg_x, count(*) OVER g AS group_by_k_count
        FROM om WINDOW g AS (PARTITION BY k)"""),
    "group_by_then_min": _group("o_orderpriority", "o_totalprice", "min"),
    "group_by_then_max": _group("o_orderpriority", "o_totalprice", "max"),
    "group_by_then_avg": _group("o_orderpriority", "o_totalprice", "avg"),
    "group_by_then_count": _group("o_orderpriority", "o_totalprice", "count"),
    "group_by_then_many_keys": _group("o_custkey", "o_totalprice", "min", "max", "avg", "count"),
    "generate_features": (generated, _generated_sql()),
    "limit_cardinality": (capped, """
        WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)
        SELECT p_partkey, CASE WHEN p_brand IS NULL OR p_brand IN (SELECT p_brand FROM top) THEN p_brand
                               ELSE 'other' END AS p_brand FROM part"""),
}
