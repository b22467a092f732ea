"""Approximate nearest neighbours by cosine with an inverted multi-index.

The two halves of the unit vectors are quantised separately, by k-means over a sample of at most ``sample`` rows; a pair of
centroids is a cell.  All rows are indexed: each block of rows is ordered by cell, and a table counts the rows of each
cell (``centroids`` squared at most).  A query walks the pairs of centroids in order of the summed squared distance of its
halves, with a heap, until the cells hold ``visit`` of all rows (and ``least`` at least); in each block the entries of
these cells are reranked by the exact cosine of the original vectors, in doubles.

``visit`` is fitted on the sample, as the share of rows in that order which holds ``recall`` of the true neighbours of some
of its rows; on vectors without clusters, such as random directions, this share is large, for any method.

Blocks are drawn by a hash, so a cell that holds a third of all rows is spread like any other.

Edge cases: vectors that are NULL, zero or hold NULL, NaN or infinity, and rows with a NULL id, take no part; shorter vectors
are read as ending in zeros; a query that repeats counts once (its smallest vector), candidates that repeat are
listed each; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabloom.llm.common import table, written
from tabloom.llm.vectors import against_all, matrix, whole


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small vectors keep their direction
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids; starts from rows spread over the sample."""
    distinct = np.unique(x, axis=0)
    centroids = distinct[np.random.default_rng(5).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


@dataclass
class MultiIndex:
    width: int
    halves: list[np.ndarray]  # centroids of the first and second half
    visit: float

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.halves[0].shape[1]], x[:, self.halves[0].shape[1]:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = (distances(part, c).argmin(1) for part, c in zip(self.split(x), self.halves))
        return first * len(self.halves[1]) + second

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Cells in order of summed distance: the multi-sequence algorithm."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        first, second, n = first[a].tolist(), second[b].tolist(), len(second)
        heap, seen = [(first[0] + second[0], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(a[i]) * n + int(b[j])
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(first) and p[1] < n and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (first[p[0]] + second[p[1]], *p))

    def visited(self, x: np.ndarray, counts: np.ndarray, rows: float) -> Iterator[list[int]]:
        for first, second in zip(*(distances(part, c) for part, c in zip(self.split(x), self.halves))):
            found, held = [], 0
            for cell in self.walk(first, second):
                if held >= rows:
                    break
                if counts[cell]:
                    found.append(cell)
                    held += counts[cell]
            yield found


def fit(sample: np.ndarray, centroids: int, k: int, recall: float) -> MultiIndex:
    """From unit vectors, a row each."""
    half = max(1, sample.shape[1] // 2)
    size = int(min(centroids, max(1, len(sample) ** 0.5)))
    index = MultiIndex(sample.shape[1], [k_means(sample[:, :half], size), k_means(sample[:, half:], size)], 1.0)
    asked = np.arange(0, len(sample), max(1, len(sample) // 192))
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    cell = [distances(part, c) for part, c in zip(index.split(sample), index.halves)]
    codes = [d.argmin(1) for d in cell]
    summed = cell[0][asked][:, codes[0]] + cell[1][asked][:, codes[1]]
    # The share of rows whose cell is at most as far as that of a true neighbour.
    needed = (summed[:, None, :] <= np.take_along_axis(summed, best, 1)[:, :, None]).mean(2)
    index.visit = float(np.quantile(needed, recall)) if len(sample) > 1 else 1.0
    return index


def nearest(df: DataFrame, is_query: Column, k: int, centroids: int = 64, sample: int = 8192, recall: float = 0.97,
            least: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest other rows found for each query."""
    rows = df.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & whole("embedding") & F.exists("embedding", lambda x: x != 0))
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0)),
                                   F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    drawn = rows.select("embedding", F.xxhash64("vec_id", F.lit(3)).alias("draw")).orderBy("draw", "embedding").limit(sample)
    picked = matrix(pa.array([r[0] for r in drawn.select("embedding").collect()], pa.list_(pa.float64())), width)
    index = fit(unit(picked), centroids, k, recall) if n else MultiIndex(width, [np.zeros((1, 1))] * 2, 1.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(unit(matrix(batch.column("embedding"), width))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], ["vec_id", "embedding", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = written(rows.mapInArrow(place, f"vec_id long, embedding {kind}, cell int"), "multi-index")
    counts = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # one row for each cell
        counts[cell] = count
    wanted = max(least, index.visit * n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = list(index.visited(unit(matrix(batch.column("embedding"), width)), counts, wanted)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                                             ["vec_id", "embedding", "cells"])

    queries = (rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
               .mapInArrow(walk, f"vec_id long, embedding {kind}, cells array<int>"))

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if block.num_rows:
            order = np.argsort(block.column("cell").to_numpy(), kind="stable")
            ids, x = block.column("vec_id").to_numpy()[order], matrix(block.column("embedding"), width)[order]
            size = np.sqrt((x * x).sum(1))
            ends = np.cumsum(np.bincount(block.column("cell").to_numpy(), minlength=len(counts)))
            starts = ends - np.diff(ends, prepend=0)
            for key, q, cells in zip(asked.column("vec_id").to_pylist(), matrix(asked.column("embedding"), width),
                                     asked.column("cells").to_pylist()):
                sizes = (ends - starts)[cells]
                at = np.repeat(starts[cells] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                at = at[ids[at] != key]
                scores = (x[at] * q).sum(1) / (size[at] * np.sqrt((q * q).sum()))
                best = np.lexsort((ids[at], -scores))[:k]
                found.append((np.full(len(best), key), ids[at][best], scores[best]))
        q, v, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0),) * 3
        return pa.table({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.float64)})

    found = against_all(placed, queries, search, "query_id long, vec_id long, score double", n, n_queries)
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
