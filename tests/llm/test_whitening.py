"""Whitening against a dense eigendecomposition and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, x string, n int, part int"


def dense(vectors: list[tuple], k: int = 4):
    """n, sums, mean, eigenvalues, eigenvectors, trace of the distinct integer vectors."""
    fit = sorted(set(vectors))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * v - s for v, s in zip(row, sums)] for row in fit], float) / n
    cov = centred.T @ centred / n
    values, found = np.linalg.eigh(cov)
    return n, sums, np.array([s / n for s in sums]), values[::-1][:k], found[:, ::-1][:, :k], np.trace(cov)


def check(rows: list[tuple], vectors: dict, k: int, close: float = 1e-9):
    """``rows`` of the operator against the dense way; ``vectors`` by id, which is unique."""
    n, sums, mean, values, found, trace = dense([tuple(v) for v in vectors.values()], k)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == k * len(vectors)
    for c in range(k):
        ours = np.array([got[i, c + 1]["whitened"] for i in vectors])
        want = (np.array(list(vectors.values()), float) - mean) @ found[:, c] / np.sqrt(values[c])
        assert min(np.abs(ours - want).max(), np.abs(ours + want).max()) < close
        first = got[next(iter(vectors)), c + 1]
        assert abs(first["explained"] / (values[c] / trace) - 1) < 1e-9 and first["identity_error"] < 1e-9
    for i, v in vectors.items():
        assert got[i, 1]["n"] == n and int(got[i, 1]["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(v, sums))


def test_random_vectors_with_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(w, "ROWS", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12) + 40
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(2000, rows[4][1][:7])]
    odd = [(3000, None), (3001, [1.0, None]), (3002, [math.nan] * 12), (3003, [math.inf] * 12)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows + odd], SCHEMA).repartition(7)
    vectors = {i: [math.floor(256 * v) for v in vec] + [0] * (12 - len(vec)) for i, vec in rows}
    check(w.whitened(df).collect(), vectors, 4)
    # Copies and rows without an id are whitened, and change nothing for the others.
    more = df.unionByName(df.limit(5)).unionByName(df.filter("vec_id = 7").withColumn("vec_id", F.lit(None).cast("long")))
    assert w.whitened(more).count() == 4 * (len(rows) + 6 - more.filter("vec_id >= 3000").count() + len(odd))


def test_groups_of_partitions_and_wide_integers(spark, monkeypatch):
    monkeypatch.setattr(w, "TOGETHER", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(60, 5)) * [1e15, 1e14, 1e13, 1e12, 1e11])]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA).repartition(6)
    vectors = {i: [math.floor(256 * v) for v in vec] for i, vec in rows}
    monkeypatch.setattr(w, "written", lambda frame, name: frame.repartition(5))
    n, sums = len(rows), [sum(c) for c in zip(*vectors.values())]
    got = w.whitened(df, 1).collect()
    fits = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in vectors.items()}
    assert all(r["deviation"] is None if fits[r["vec_id"]] >= 10 ** 38 else int(r["deviation"]) == fits[r["vec_id"]] for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [])], 0), ([(1, None)], 0),
    ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 1), ([(i, [float(i), float(i * i % 7), 5.0]) for i in range(20)], 2)])
def test_few_components(spark, rows, components):
    got = w.whitened(spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)).collect()
    assert len(got) == components * len(rows)
    if components:
        check(got, {i: [int(256 * c) for c in v] for i, v in rows}, components)


def test_eigenvectors_of_clustered_spectra():
    rng = np.random.default_rng(1)
    for values in ([5, 5, 5, 5, 5, 1], list(np.linspace(2, 1.9, 40)), [1] * 30, [3, 1e-9, 0, 0], [1e9, 1, 1e-3] + [1e-4] * 50):
        turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        m = turn * np.array(values, float) @ turn.T
        m = (m + m.T) / 2
        got, vectors = w.jacobi_davidson(lambda v: m @ v, len(values), 4)
        want = np.sort(values)[::-1][:4]
        assert np.abs(got - want).max() < 1e-13 * want[0]
        assert np.linalg.norm(m @ vectors - vectors * got, axis=0).max() < 1e-13 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = w.op11_embedding_whitening(spark, path).collect()
    stored = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    check(rows, {r["vec_id"]: [math.floor(256 * c) for c in r["embedding"]] for r in stored}, 4, 1e-8)
