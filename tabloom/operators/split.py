"""Row splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.functions.hashing import BUCKETS, hash_bucket, row_hash


def split_number(weights: Sequence[float], keys: Sequence[str], seed: int = 0, portable: bool = False) -> Column:
    """0 for rows of the first part, 1 for the second, and so on."""
    shares = [w / sum(weights) for w in accumulate(weights)][:-1]
    if portable:  # in thousandths, which other engines can follow
        edges, bucket = [round(BUCKETS * s) for s in shares], hash_bucket(keys, seed, BUCKETS, portable)
    else:
        edges = [min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)) for s in shares]
        bucket = row_hash(keys, seed)
    number = F.lit(0)
    for edge in edges:
        number = number + F.when(bucket >= edge, 1).otherwise(0)
    return number


def hash_split(df: DataFrame, weights: Sequence[float], keys: Sequence[str] | None = None,
               seed: int = 0, portable: bool = False) -> list[DataFrame]:
    """Disjoint parts that together hold every row; equal keys go to the same part.

    Without ``keys`` the whole row is the key, so copies of a row never straddle train and test.
    """
    number = split_number(weights, keys or df.columns, seed, portable)
    return [df.filter(number == i) for i in range(len(weights))]
