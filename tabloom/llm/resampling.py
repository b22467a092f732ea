"""Importance resampling of documents towards a target set.

Features are runs of consecutive words, hashed into buckets.  A bucket's gain is the logarithm of how much likelier it is in
the target than in the documents, in thousandths; a document's weight is the mean gain of its features.  Weights come
from arrays: tasks turn texts into bucket numbers and look up one array of gains, whose length is the number of buckets.
Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

The draw is a distributed quickselect.  Rows have the composite key (falling score, id, number of features).  Each round
takes a few random pivot keys of the open interval, counts the rows below, at and above each pivot exactly, and keeps the
interval (or the pivot) that holds the k-th row.  Only keys up to the k-th are sorted and ranked: rows alike are one
row with a count first, so that copies of one row don't meet in a task.

Edge cases: a NULL or empty text has no feature and weight 0; a NULL id is hashed as the empty string and comes after all
others in a tie; rows that are alike in id, features, weight and score get consecutive ranks, and if the draw ends
among them as many are drawn as fit; an empty table gives no row, an empty target gives T = 0.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tabloom.llm.common import in_arrow, pieces, raw_bytes, table, words, written

#: What a byte of a text becomes: ASCII letters in lower case, digits and all bytes of other letters as they are,
#: anything else a blank.
BYTES = np.full(256, 0x20, np.uint8)
BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
BYTES[0x80:] = np.arange(0x80, 0x100)

PIVOTS = 24
CHUNK = 1 << 16


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with ``least`` words or more are drawn."""

    percent: int = 10
    least: int = 20
    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024


def word_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, distinct words), as ``common.words`` gives them, of words of letters and digits."""
    raw, offsets = raw_bytes(pc.fill_null(texts, "").cast(pa.large_string()))
    return words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(BYTES[raw])), lower=False)


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature)."""
    starts, codes, distinct = word_lists(texts)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at, run, names = np.arange(len(owner)), codes, distinct  # where the runs begin, and which they are
    owners, numbers = [], []
    for n in range(1, longest + 1):
        if n > 1:  # a run of n words is a run of n - 1 and the word after it
            more = at + n - 1 < len(owner)
            more[more] = owner[at[more] + n - 1] == owner[at[more]]
            at, run = at[more], run[more]
            run, names = _coded(pc.binary_join_element_wise(
                names.take(pa.array(run)), distinct.take(pa.array(codes[at + n - 1])), pa.scalar(" ", distinct.type)))
        crc = np.fromiter((zlib.crc32(w) for w in names.cast(pa.large_binary()).to_pylist()), np.int64, len(names))
        numbers.append((crc % buckets)[run])
        owners.append(owner[at])
    return sizes, np.concatenate(owners), np.concatenate(numbers)


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def bucket_counts(df: DataFrame, draw: Draw, text: str = "text") -> np.ndarray:
    """Features of all rows by bucket: one array, as long as there are buckets."""
    longest, buckets = draw.longest, draw.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, text):
                total += np.bincount(feature_buckets(piece.column(text), longest, buckets)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    found = in_arrow(df.select(text), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of log-likelihood ratios with one added to every count, rounded down."""
    size = len(here)
    above = (target + 1).astype(np.float64) * float(here.sum() + size)
    below = (here + 1).astype(np.float64) * float(target.sum() + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def noise(key: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(df: DataFrame, gain: np.ndarray, draw: Draw, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key, n_words, n_features, weight and score."""
    longest = draw.longest
    slim = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                n_words, owner, number = feature_buckets(piece.column(text), longest, len(gain))
                n = np.bincount(owner, minlength=len(n_words))
                total = np.bincount(owner, gain[number], len(n_words)).astype(np.int64)  # exact: far below 2^53
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(total // np.maximum(n, 1))], [key, "n_words", "n_features", "weight"])

    out = in_arrow(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(key, draw.seed))


def _order(key: str) -> list[Column]:
    return [(-F.col("score")).alias("a"), F.col(key).isNull().alias("b"), F.coalesce(key, F.lit(0)).cast("long").alias("c"),
            F.col("n_features").alias("d")]


def _literal(pivot: tuple) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(pivot, ("long", "boolean", "long", "long"), "abcd")])


def kth_key(rows: DataFrame, k: int, key: str = "doc_id", seed: int = 0) -> tuple:
    """The composite key of the k-th row in order: each round counts exactly how many rows lie below, at and between
    the random pivots, and goes on with the part that holds it."""
    keyed = rows.select(F.struct(*_order(key)).alias("key"))
    low = high = None
    for turn in range(10_000):
        inside = keyed
        if low is not None:
            inside = inside.filter(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.filter(F.col("key") < _literal(high))
        drawn = inside.orderBy(F.xxhash64("key", F.lit(seed + turn))).limit(PIVOTS).collect()
        pivots = sorted({tuple(r["key"]) for r in drawn})
        # 2i: below pivot i and above the one before; 2i + 1: equal to pivot i.
        place = sum(((F.col("key") > _literal(p)).cast("int") + (F.col("key") >= _literal(p)).cast("int") for p in pivots), F.lit(0))
        counts = dict(inside.groupBy(place.alias("place")).count().collect())
        for at in range(2 * len(pivots) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        if at % 2:
            return pivots[at // 2]
        low = pivots[at // 2 - 1] if at else low
        high = pivots[at // 2] if at // 2 < len(pivots) else high
    raise RuntimeError("no end of the selection")


def _ranked(winners: DataFrame, k: int, key: str) -> DataFrame:
    """The winners with ranks 1 to k, in order; copies beyond k have none.

    Rows alike are one row with a count while they are sorted, over range partitions; the driver sees a total per partition."""
    names = [key, "n_words", "n_features", "weight", "score"]
    alike = winners.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    order = _order(key)
    placed = written(alike.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-winners")
    totals = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("copies")).collect())
    ends = np.cumsum([n for _, n in totals])
    before = placed.sparkSession.createDataFrame(
        [(p, int(e - n)) for (p, n), e in zip(totals, ends)], "part int, before long")
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    started = (placed.join(F.broadcast(before), "part")
               .withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0)) + 1))
    # One key may hold very many copies: they are listed in chunks that different tasks can take.
    chunks = (started.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1), F.lit(CHUNK).cast("long"))))
              .repartition(key, "chunk"))
    last = F.least(F.col("copies"), F.col("chunk") + CHUNK) - 1
    listed = chunks.withColumn("rank", F.explode(F.sequence(F.col("first") + F.col("chunk"), F.col("first") + last)))
    return listed.select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))


def resampled(df: DataFrame, target: DataFrame, draw: Draw = Draw(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df``: key, n_words, n_features, weight, score, and rank where it is drawn."""
    gain = gains(bucket_counts(df, draw, text), bucket_counts(target, draw, text))
    rows = written(scored(df, gain, draw, key, text), "resampling-scores")
    may = F.col("n_words") >= draw.least
    k = rows.filter(may).count() * draw.percent // 100
    unranked = rows.withColumn("rank", F.lit(None).cast("long"))
    if not k:
        return unranked
    wins = may & (F.struct(*_order(key)) <= _literal(kth_key(rows.filter(may), k, key, draw.seed)))
    return _ranked(rows.filter(wins), k, key).unionByName(unranked.filter(~wins))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS} AS w FROM documents),
  u AS (SELECT row_no, unnest(w) AS word FROM d),
  n AS (SELECT row_no, word, count(*) AS n FROM u GROUP BY ALL),
  b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
  names AS (SELECT DISTINCT word FROM u UNION SELECT word FROM b),
  bits AS (SELECT list(list_reduce([byte, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY byte) AS t
           FROM (SELECT unnest(range(256)) AS byte)),
  hexed AS (SELECT word, hex(encode(word)) AS h FROM names),
  hashed AS (SELECT word, (xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)]),
               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000)::INTEGER AS bucket FROM hexed, bits),
  here AS (SELECT bucket, sum(n)::BIGINT AS s FROM n JOIN hashed USING (word) GROUP BY bucket),
  there AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
  gained AS (SELECT h.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM here) + 10000)::DOUBLE)
               / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM there), 0) + 10000)::DOUBLE)))::BIGINT AS gain
             FROM here h LEFT JOIN there USING (bucket)),
  summed AS (SELECT row_no, sum(n * gain)::BIGINT AS total FROM n JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY row_no),
  weighed AS (SELECT row_no, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0
                ELSE (coalesce(total, 0) - ((coalesce(total, 0) % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
                ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
              FROM d LEFT JOIN summed USING (row_no)),
  scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
  ranked AS (SELECT row_no, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, row_no) AS r
             FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= 10 * (SELECT count(*) FROM ranked) // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (row_no)"""
