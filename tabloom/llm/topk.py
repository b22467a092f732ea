"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Components become integers, floor(scale * x), and those are split into quantised impacts: a high level in steps of an eighth of
the block's range, a low level in steps of a sixty-fourth, and a rest.  The posting segments of a level (rows and quantised
impacts of each dimension; no posting where the impact is zero) lie side by side, so a batch of queries adds the high level of all
dimensions at once.  What a row can still gain is at most the norm of what its levels have left times that of the query.
The k rows that look best are scored exactly, which gives a threshold; rows that can't reach it go, the low level is added
for the others, and so on until few rows are left, or no level.  Those possible members are scored anew, exactly.

The first block of rows is searched first.  The k-th score that a query finds there is its starting threshold in all other blocks, so
they return few rows, or are passed over if the largest norm proves that none can enter.  The best of all blocks meet in a
window for each query.

Edge cases: vectors that are NULL or hold NULL, NaN or infinity, and rows with a NULL id, take no part; shorter vectors are
read as ending in zeros; where sums may
leave the 53 bits of a float, pruning has a margin for rounding and scores are sums of Python integers; a score beyond 64 bits is an
error, as in SQL; a query that repeats counts
once (its smallest vector), candidates that repeat are listed each; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabloom.llm.common import table, written
from tabloom.llm.vectors import against_all, matrix, whole

EXACT = 2.0 ** 52


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x, all integers."""
    if (np.abs(x).max(0, initial=0.0) * np.abs(q)).sum() <= EXACT:
        return (x @ q).astype(np.int64)
    of = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, of)) for row in x], np.int64)


class ImpactIndex:
    """The impacts of a block of rows by levels, with the norms of what each level leaves."""

    def __init__(self, x: np.ndarray, steps: tuple[int, ...] = (8, 64)):
        self.x, self.levels, self.left = x, [], [np.sqrt((x * x).sum(1))]
        self.most, self.read = np.abs(x).max(0, initial=0.0), 0
        rest, top = x, 2.0 ** np.ceil(np.log2(self.most.max(initial=0.0) + 1))
        for n in steps:
            step = max(1.0, top / n)
            impacts = np.rint(rest / step) * step
            rest = rest - impacts
            self.levels.append(impacts)
            self.left.append(np.sqrt((rest * rest).sum(1)))
        self.postings = [(level != 0).sum(1) for level in self.levels]

    def high(self, queries: np.ndarray) -> np.ndarray:
        """The sums of the highest level, a row for each query."""
        return queries @ self.levels[0].T

    def members(self, q: np.ndarray, k: int, few: int, sums: np.ndarray | None = None, floor: float = -np.inf,
                barred: np.ndarray | None = None) -> np.ndarray:
        """Rows among which the k best that aren't barred are sure to be, with all that tie with the k-th, as far as they reach
        ``floor``; ``read`` counts the postings."""
        norm = np.sqrt((q * q).sum())
        slack = 8 * (len(q) + 8) * (np.abs(q) * self.most).sum() / EXACT
        # Comparisons are written so that sums beyond the range of floats keep their rows.
        rows = np.flatnonzero(~(self.left[0] * norm + slack < floor))
        if barred is not None:
            rows = np.setdiff1d(rows, barred)
        if not len(rows):
            return rows
        sums = (self.high(q[None])[0] if sums is None else sums)[rows]
        for level in range(len(self.levels)):
            if level:
                sums = sums + self.levels[level][rows] @ q
            self.read += int(self.postings[level][rows].sum())
            if k <= len(rows):
                best = rows[np.argpartition(sums, len(rows) - k)[len(rows) - k:]]
                floor = max(floor, float(min(products(self.x[best], q))))
            possible = ~(sums + self.left[level + 1][rows] * norm + slack < floor)
            rows, sums = rows[possible], sums[possible]
            if len(rows) <= few:
                break
        return rows


def top_k(df: DataFrame, is_query: Column, k: int, scale: float = 64.0, row_block: int = 8192, batch: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each query."""
    rows = df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & whole("embedding"))
    queries = written(rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
                      .withColumn("floor", F.lit(None).cast("long")), "queries")
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()

    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        ids, found = block.column("vec_id").to_numpy(), []
        if len(ids) and asked.num_rows:
            width = max(1, *(int(t.column("embedding").combine_chunks().value_lengths().to_numpy().max()) for t in (block, asked)))
            index = ImpactIndex(integers(matrix(block.column("embedding"), width), scale))
            keys, of = asked.column("vec_id").to_pylist(), integers(matrix(asked.column("embedding"), width), scale)
            floors, order = asked.column("floor").to_pylist(), np.argsort(ids, kind="stable")
            for at in range(0, len(keys), batch):
                high = index.high(of[at:at + batch])
                for key, q, sums, floor in zip(keys[at:at + batch], of[at:at + batch], high, floors[at:at + batch]):
                    own = order[slice(*(np.searchsorted(ids, key, side, sorter=order) for side in ("left", "right")))]
                    members = index.members(q, k, 2 * k, sums, -np.inf if floor is None else floor, own if len(own) else None)
                    scores = products(index.x[members], q)
                    best = np.lexsort((ids[members], -scores))[:k]
                    found.append((np.full(len(best), key), ids[members][best], scores[best]))
        q, v, s = (np.concatenate(c).astype(np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    def against(part: DataFrame, asked: DataFrame, size: int) -> DataFrame:
        return against_all(part, asked, search, "query_id long, vec_id long, score long", size, n_queries, row_block, row_block)

    blocks = max(1, -(-n_rows // row_block))
    found = against(rows, queries, n_rows)
    if blocks > 1:
        first = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == 0
        begun = written(against(rows.filter(first), queries, row_block), "first-block")
        floors = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
        asked = queries.drop("floor").join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        found = begun.unionByName(against(rows.filter(~first), asked, n_rows))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20"""
