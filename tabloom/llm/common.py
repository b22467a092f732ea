"""Helpers of the text operators: words of whole texts as numpy codes, text pieces of bounded size, written tables."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tabloom.operators.scratch import scratch_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs start from the files, so a lost executor
    costs nothing, and the optimiser knows the size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(spark: SparkSession, size: int) -> None:
    """Arrow batches of this session hold about ``size`` bytes at most: rows alone don't bound whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Returns free memory of this Python worker to the system.  Spark keeps workers for later tasks, so what each
    stage leaves behind would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches, or of groups, that leaves no free memory in its worker."""
    if inspect.isgeneratorfunction(run):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            give_back()

        return task
    if len(inspect.signature(run).parameters) == 2:  # Spark counts the parameters
        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            out = run(left, right)
            give_back()
            return out

        return pair

    def group(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    return group


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, by tasks that leave no free memory in their worker."""
    batches_of(df.sparkSession, BATCH_BYTES)
    return df.mapInArrow(tidy(run), schema)


def crc32_of(column: str) -> Column:
    """crc32 of an integer column written as text; NULL for NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, distinct): the words of text i, ASCII letters in lower case, are
    ``distinct[codes[starts[i]:starts[i + 1]]]``.  NULL is an empty text."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy().astype(np.int64)
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    if not filled.all():  # white space at the ends of a text leaves empty words
        real = filled[codes]
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        codes = codes[real]
    return starts, codes, coded.dictionary


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts without NULLs."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, starts) of the words of texts that lie one after the other, text i from ``offsets[i]`` on: word k is
    ``raw[begin[k]:end[k]]``, and those of text i are ``starts[i]`` to ``starts[i + 1]``."""
    space = (raw == 0x20) | (raw - np.uint8(0x09) < 5)
    begins, last = ~space, ~space
    begins[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]  # a text begins a word and ends one
    begins[inner], last[inner - 1] = ~space[inner], ~space[inner - 1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, offsets)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, longest: int = 256) -> np.ndarray:
    """64 bits of hash of each ``raw[begin[k]:end[k]]``, eight bytes of all at a time; spans above ``longest`` bytes one by one."""
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def taken(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return mix((h ^ (eight[at] & masks[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))

    size = end - begin
    out = taken(mix(size.astype(np.uint64)), begin, size)
    k = np.flatnonzero((size > 8) & (size <= longest))
    at, left = begin[k] + 8, size[k] - 8
    while len(k):
        out[k] = taken(out[k], at, left)
        more = left > 8
        k, at, left = k[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > longest):
        out[k] = xxhash.xxh3_64_intdigest(raw[begin[k]:end[k]])
    return out


def word_hashes(distinct: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
