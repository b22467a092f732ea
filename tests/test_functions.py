from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

import tabloom
from tabloom.functions.arithmetic import pair_expressions
from tabloom.functions.hashing import hash_bucket
from tabloom.functions.missing import is_missing
from tabloom.functions.text import remove_non_word_characters
from tabloom.operators.roles import cast_to_roles, column_roles
from tabloom.operators.split import hash_split


def test_version():
    assert tabloom.__version__ == "0.1.0"


def test_remove_non_word_characters(spark):
    rows = [("jo&&se", "jose"), ("**li**", "li"), ("#::luisa", "luisa"), (None, None), ("été, où?", "été où")]
    df = spark.createDataFrame(rows, "name string, expected string")
    for r in df.withColumn("clean", remove_non_word_characters("name")).collect():
        assert r["clean"] == r["expected"]


def test_missing_by_type(spark):
    schema = "t string, d double, i int, b boolean"
    rows = [("a", 1.0, 1, True), ("a?b", float("nan"), None, None), ("Nonetheless", None, 0, False),
            ("", 0.0, 2, True), (None, 2.0, 3, True), (" NaN ", 3.0, 4, True), ("Null", 4.0, 5, False)]
    df = spark.createDataFrame(rows, schema)
    types = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(*[is_missing(c, types[c]).alias(c) for c in df.columns],
                    is_missing("t", types["t"], "exact").alias("exact")).collect()
    assert [r["t"] for r in got] == [False, True, True, True, True, True, True]
    assert [r["exact"] for r in got] == [False, False, False, True, True, True, True]
    assert [r["d"] for r in got] == [False, True, True, False, False, False, False]
    assert [r["i"] for r in got] == [False, True, False, False, False, False, False]
    assert [r["b"] for r in got] == [False, True, False, False, False, False, False]
    with pytest.raises(ValueError):
        is_missing("t", T.StringType(), "fuzzy")


def test_pair_arithmetic(spark):
    df = spark.createDataFrame([(6, 3), (5, 0), (4, None), (None, 2), (2**31 - 1, 1)], "a int, b int")
    made = pair_expressions("a", "b")
    got = df.select([e.alias(n) for n, e in made.items()]).collect()
    assert tuple(got[0]) == (9.0, 3.0, -3.0, 18.0, 2.0, 0.5)
    assert got[1]["division_a_b"] == 0.0 and got[1]["division_b_a"] == 0.0
    # A NULL divisor gives 0, a NULL dividend gives NULL.
    assert got[2]["division_a_b"] == 0.0 and got[2]["division_b_a"] is None
    assert got[2]["sum_a_b"] is None
    assert got[4]["sum_a_b"] == 2.0**31


def test_hash_bucket_is_md5_of_the_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    got = [r[0] for r in df.select(hash_bucket(["k", "t"], 5, portable=True)).collect()]
    want = [int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 1000 for text in ("5|1|x", "5|2")]
    assert got == want


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    parts = [{r["k"] for r in p.collect()} for p in hash_split(df, [0.7, 0.2, 0.1], ["k"], 3)]
    again = [{r["k"] for r in p.collect()} for p in hash_split(df.repartition(7), [0.7, 0.2, 0.1], ["k"], 3)]
    assert parts == again
    assert sum(map(len, parts)) == 5000 and set.union(*parts) == set(range(5000))
    assert abs(len(parts[0]) / 5000 - 0.7) < 0.03
    other = {r["k"] for r in hash_split(df, [0.7, 0.2, 0.1], ["k"], 4)[0].collect()}
    assert other != parts[0]


def test_split_of_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(i, "b") for i in range(50)], "k int, t string")
    train, test = hash_split(df, [0.5, 0.5])
    assert train.count() + test.count() == 100
    assert not set(map(tuple, train.collect())) & set(map(tuple, test.collect()))


def test_roles(spark):
    schema = "i int, g bigint, d double, m decimal(9,2), s string, b boolean, t timestamp, y string"
    df = spark.createDataFrame([], schema)
    roles = column_roles(df, "y")
    assert roles.numeric == ("i", "g", "d", "m") and roles.categorical == ("s", "b") and roles.other == ("t",)
    assert column_roles(df, strict=True).numeric == ("i", "d")
    assert roles.without(["g", "s"]).numeric == ("i", "d", "m")
    types = dict(cast_to_roles(df, roles).dtypes)
    assert types["i"] == types["g"] == types["m"] == "double" and types["b"] == "string" and types["t"] == "timestamp"


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "?"), (2.0, "b")], "`a.b` double, `c d` string")
    from tabloom.operators.profile import missing_counts
    got = {r["column"]: r["n_missing"] for r in missing_counts(df).collect()}
    assert got == {"a.b": 0, "c d": 1}
    assert df.select(F.col("`a.b`")).count() == 2


def test_split_by_small_weights(spark):
    parts = hash_split(spark.range(200_000), [0.9996, 0.0004], ["id"])
    small = parts[1].count()
    assert 40 < small < 130 and parts[0].count() == 200_000 - small
