"""Inputs of the registered queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.sources.tables import load_table

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS_SQL = ", ".join(LINE_KEYS)


def lineitem(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Line items: the key columns and the named ones."""
    return load_table(spark, sf, "lineitem", [*LINE_KEYS, *columns])


def orders_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a numeric column ``x`` and a categorical column ``k`` that have missing values."""
    orders = load_table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("x"),
        F.when(key % 5 == 0, F.lit("?")).when(key % 11 != 0, F.col("o_orderpriority")).alias("k"))


GAPS_SQL = """om AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x,
         CASE WHEN o_orderkey % 5 = 0 THEN '?' WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS k
  FROM orders)"""


def missing_text_sql(name: str) -> str:
    return (f"({name} IS NULL OR contains({name}, '?') OR contains({name}, 'None') OR contains({name}, 'Null') "
            f"OR {name} = '' OR lower(trim({name})) = 'nan')")


def bucket_sql(seed: int, keys: list[str], buckets: int = 1000) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8))::BIGINT % {buckets})"


# Multipliers that scatter the keys of a line.
_PRIMES = {"l_orderkey": 7919, "l_partkey": 104729, "l_suppkey": 1299709, "l_linenumber": 15485863}
_NOISE = " + ".join(f"{k} * {p}" for k, p in _PRIMES.items())


def labelled_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a binary label ``flagged`` and a numeric label ``demand``; both depend on some of
    the columns, plus noise from the key."""
    df = load_table(spark, sf, "lineitem", [*LINE_KEYS, *LINE_NUMBERS, "l_returnflag", "l_linestatus"])
    noise = sum(F.col(k) * p for k, p in _PRIMES.items()) % 1000 / 1000.0
    risk = (F.col("l_quantity") * 0.02 + F.col("l_discount") * 5
            + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0) + noise * 0.4)
    return df.select("*", (risk > 1.0).cast("int").alias("flagged"),
                     (F.col("l_quantity") * 3 - F.col("l_discount") * 200 + noise * 20).alias("demand"))


LABELLED_SQL = f"""labelled AS (
  SELECT *,
         CASE WHEN l_quantity * 0.02 + l_discount * 5 + CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0.0 END
              + ({_NOISE}) % 1000 / 1000.0 * 0.4 > 1.0 THEN 1 ELSE 0 END AS flagged,
         l_quantity * 3 - l_discount * 200 + ({_NOISE}) % 1000 / 1000.0 * 20 AS demand
  FROM lineitem)"""


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)
