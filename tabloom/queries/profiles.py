"""Queries of column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabloom.operators.profile import (
    describe,
    meta_features,
    missing_counts,
    missing_flags,
    pearson_matrix,
    spearman_matrix,
)
from tabloom.operators.projection import explained_variance
from tabloom.operators.roles import column_roles, role_table
from tabloom.operators.tally import count_values, max_count_distinct, most_frequent, present_text
from tabloom.queries.inputs import GAPS_SQL, LINE_NUMBERS, missing_text_sql, orders_with_gaps, r6
from tabloom.sources.tables import load_table


def _numbers(spark, sf) -> DataFrame:
    return load_table(spark, sf, "lineitem", LINE_NUMBERS)


def scan_profile(spark, sf) -> DataFrame:
    return describe(_numbers(spark, sf), LINE_NUMBERS, ["count", "mean", "stddev", "min", "max"]).select(
        "feature", "statistic", r6("value"))


def _statistic(name: str):
    def query(spark, sf) -> DataFrame:
        return describe(_numbers(spark, sf), LINE_NUMBERS, [name]).select("feature", r6("value"))
    return query


def roles(spark, sf) -> DataFrame:
    tables = []
    for name in ("orders", "lineitem", "events"):
        df = load_table(spark, sf, name)
        tables.append(role_table(df, column_roles(df)).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, tables)


def flags(spark, sf) -> DataFrame:
    return missing_flags(orders_with_gaps(spark, sf), ["x", "k"]).select("o_orderkey", "missing_x", "missing_k")


def counts(spark, sf) -> DataFrame:
    return missing_counts(orders_with_gaps(spark, sf))


def document_counts(spark, sf) -> DataFrame:
    return missing_counts(load_table(spark, sf, "documents"))


def frequent(spark, sf) -> DataFrame:
    gaps = orders_with_gaps(spark, sf)
    orders = load_table(spark, sf, "orders", ["o_orderstatus", "o_orderpriority"])
    found = most_frequent(count_values(gaps, present_text(gaps, ["k"])))
    return found.unionByName(most_frequent(count_values(orders, present_text(orders, orders.columns))))


def bins(spark, sf) -> DataFrame:
    rows = [(name, max_count_distinct(load_table(spark, sf, name, columns), columns))
            for name, columns in (("orders", ["o_orderstatus", "o_orderpriority"]),
                                  ("part", ["p_brand", "p_type", "p_name"]),
                                  ("documents", ["lang", "source"]))]
    return spark.createDataFrame(rows, "table_name string, max_bins bigint")


def pearson(spark, sf) -> DataFrame:
    return pearson_matrix(_numbers(spark, sf), LINE_NUMBERS).select("a", "b", r6("value"))


def spearman(spark, sf) -> DataFrame:
    return spearman_matrix(_numbers(spark, sf), LINE_NUMBERS).select("a", "b", r6("value"))


def meta(spark, sf) -> DataFrame:
    return meta_features(_numbers(spark, sf), LINE_NUMBERS).select("feature", "statistic", r6("value"))


def variance(spark, sf) -> DataFrame:
    return explained_variance(_numbers(spark, sf), ["l_quantity", "l_extendedprice"]).select(
        "component", r6("explained"))


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _skewness(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {{s}} round(avg(({c} - m) ** 3) / avg(({c} - m) ** 2) ** 1.5, 6) AS value
      FROM lineitem, (SELECT avg({c}) AS m FROM lineitem)"""


def _kurtosis(c: str) -> str:
    return f"SELECT '{c}' AS feature, {{s}} round(kurtosis_pop({c}), 6) AS value FROM lineitem"


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE_NUMBERS
) + " FROM lineitem)"


def _correlations(table: str) -> list[str]:
    return [f"SELECT '{a}' AS a, '{b}' AS b, "
            + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + f" AS value FROM {table}"
            + (" LIMIT 1" if a == b else "")
            for a in LINE_NUMBERS for b in LINE_NUMBERS]


def _matrix(table: str) -> str:
    return _union(f"({s})" for s in _correlations(table))


def _pairs(table: str, name: str) -> list[str]:
    return [f"SELECT '{a}|{b}' AS feature, '{name}' AS statistic, round(corr({a}, {b}), 6) AS value FROM {table}"
            for a in LINE_NUMBERS for b in LINE_NUMBERS if a < b]


def _role_rows() -> list[str]:
    kinds = {
        "orders": {"numeric": ["o_orderkey", "o_custkey", "o_totalprice"],
                   "categorical": ["o_orderstatus", "o_orderpriority"], "other": ["o_orderdate"]},
        "lineitem": {"numeric": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS],
                     "categorical": ["l_returnflag", "l_linestatus"], "other": ["l_shipdate"]},
        "events": {"numeric": ["event_id", "user_id", "value"], "categorical": ["event_type", "props"],
                   "other": ["ts"]},
    }
    return [f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{role}' AS role, count({c}) AS n_present FROM {t}"
            for t, by in kinds.items() for role, names in by.items() for c in names]


_PCA = """
WITH m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice) AS b,
                  var_samp(l_extendedprice) AS c FROM lineitem),
     e AS (SELECT ((a + c) + sqrt((a - c) ** 2 + 4 * b ** 2)) / 2 / (a + c) AS first FROM m)
SELECT 1::INTEGER AS component, round(first, 6) AS explained FROM e
UNION ALL SELECT 2::INTEGER, round(1 - first, 6) FROM e"""


QUERIES = {
    "scan_profile": (scan_profile, _union(
        f"SELECT '{c}' AS feature, '{s}' AS statistic, round({f}::DOUBLE, 6) AS value FROM lineitem"
        for c in LINE_NUMBERS for s, f in (("count", f"count({c})"), ("mean", f"avg({c})"),
                                           ("stddev", f"stddev_samp({c})"), ("min", f"min({c})"),
                                           ("max", f"max({c})")))),
    "column_roles": (roles, _union(_role_rows())),
    "missing_flags": (flags, f"""WITH {GAPS_SQL}
        SELECT o_orderkey, x IS NULL OR isnan(x) AS missing_x, {missing_text_sql('k')} AS missing_k FROM om"""),
    "missing_counts": (counts, f"""WITH {GAPS_SQL}
        SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS n_missing FROM om
        UNION ALL SELECT 'x', count(*) FILTER (x IS NULL OR isnan(x)) FROM om
        UNION ALL SELECT 'k', count(*) FILTER ({missing_text_sql('k')}) FROM om"""),
    "missing_counts_documents": (document_counts, _union(
        [f"SELECT '{c}' AS \"column\", count(*) FILTER ({missing_text_sql(c)}) AS n_missing FROM documents"
         for c in ("text", "lang", "source")]
        + [f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing FROM documents"
           for c in ("doc_id", "n_chars")])),
    "most_frequent_value": (frequent, f"""WITH {GAPS_SQL},
        c AS (SELECT 'k' AS "column", k AS value, count(*) AS n FROM om
              WHERE NOT {missing_text_sql('k')} GROUP BY k
              UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
              UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)
        SELECT "column", value, n FROM c
        QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1"""),
    "max_count_distinct": (bins, """
        SELECT 'orders' AS table_name, 1 + greatest(count(DISTINCT o_orderstatus),
               count(DISTINCT o_orderpriority)) AS max_bins FROM orders
        UNION ALL SELECT 'part', 1 + greatest(count(DISTINCT p_brand), count(DISTINCT p_type),
               count(DISTINCT p_name)) FROM part
        UNION ALL SELECT 'documents', 1 + greatest(count(DISTINCT lang), count(DISTINCT source)) FROM documents"""),
    "skewness": (_statistic("skewness"), _union(_skewness(c).format(s="") for c in LINE_NUMBERS)),
    "kurtosis": (_statistic("kurtosis"), _union(_kurtosis(c).format(s="") for c in LINE_NUMBERS)),
    "pearson_matrix": (pearson, _matrix("lineitem")),
    "spearman_matrix": (spearman, f"WITH {_RANKS} " + _matrix("ranks")),
    "meta_features": (meta, f"WITH {_RANKS} " + _union(
        [_skewness(c).format(s="'skewness' AS statistic,") for c in LINE_NUMBERS]
        + [_kurtosis(c).format(s="'kurtosis' AS statistic,") for c in LINE_NUMBERS]
        + _pairs("lineitem", "pearson") + _pairs("ranks", "spearman"))),
    "pca_explained_variance": (variance, _PCA),
}
