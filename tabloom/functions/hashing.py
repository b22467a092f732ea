"""Deterministic row buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tabloom.functions.columns import as_text, ref

BUCKETS = 1000


def row_hash(keys: Sequence[str], seed: int = 0) -> Column:
    """A signed 64-bit hash of the seed and the key columns."""
    return F.xxhash64(F.lit(seed), *[ref(k) for k in keys])


def hash_bucket(keys: Sequence[str], seed: int = 0, buckets: int = BUCKETS, portable: bool = False) -> Column:
    """A bucket in [0, buckets) from a hash of the seed and the key columns.

    It depends on the values only, so it does not move when the data is re-partitioned or a task is
    retried.  The default hash is fast; the ``portable`` one is the md5 of the values as text, which any
    other engine can compute.
    """
    if not portable:
        return F.pmod(row_hash(keys, seed), F.lit(buckets))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_text(k) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)
