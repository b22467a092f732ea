"""Quality of texts by a regularised quadratic discriminant over document statistics.

Every text becomes ``len(STATISTICS)`` transformed statistics (logarithms and shares) of its bytes, words and lines, in
numpy over whole Arrow batches.  Of each class Spark sums the number, the sums and the products of the statistics; the
driver gets one small table of sums, whatever the size of the corpus.  A class covariance is shrunk towards the
pooled one and its diagonal; its Cholesky factor is computed once.  The score is the probability of the good class from the
difference of the two log densities and the classes' shares.

Edge cases: NULL and empty texts have the statistics of the empty text and are scored like any other; label rows that
repeat count as often as they are there, NULL labels and labels without a document are no evidence; if one class has no
row at all the score is that of the other (1 or 0), and 0.5 without any label.  Other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm.common import crc32_of, in_arrow, pieces, raw_bytes, table, words, written

STATISTICS = ("log_words", "log_word_length", "letters", "digits", "symbols", "stops", "capitals", "high_bytes",
              "word_variety", "line_variety", "log_line_length", "symbol_words", "top_word", "byte_entropy")


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)  # 0: symbols and control characters
    for kind, chars in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"),
                        (4, ".,;:!?'\"-()"), (5, " \t\n\v\f\r")):
        kinds[list(chars.encode())] = kind
    kinds[128:] = 6
    return kinds


KINDS = _kinds()


def _distinct_share(groups: np.ndarray, codes: np.ndarray, n: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the share of distinct codes, and the share of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(codes):
        pair, counts = np.unique(groups * (codes.max() + 1) + codes, return_counts=True)
        of = pair // (codes.max() + 1)
        distinct = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(top, of, counts)
    return distinct / np.maximum(size, 1), top / np.maximum(size, 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; a NULL is an empty text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    raw, offsets = raw_bytes(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    by_kind = np.bincount(doc * 7 + KINDS[raw], minlength=7 * n).reshape(n, 7).astype(float)
    by_byte = np.bincount(doc * 256 + raw, minlength=256 * n).reshape(n, 256).astype(float)
    bytes_ = np.maximum(size, 1).astype(float)
    share = by_byte / bytes_[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)

    starts, codes, distinct = words(texts)
    n_words = np.diff(starts)
    of_word = np.repeat(np.arange(n), n_words)
    variety, top = _distinct_share(of_word, codes.astype(np.int64), n, n_words)
    odd = pc.match_substring_regex(distinct, r"[^\w.,;:!?'\"()\-\x80-\x{10FFFF}]|\d").to_numpy(zero_copy_only=False).astype(float)
    odd_words = np.bincount(of_word, odd[codes] if len(codes) else None, minlength=n)

    lines = pc.split_pattern(texts, "\n")
    line_starts = lines.offsets.to_numpy().astype(np.int64)
    line_codes = lines.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = np.diff(line_starts)
    line_variety, _ = _distinct_share(np.repeat(np.arange(n), n_lines), line_codes, n, n_lines)

    dense = bytes_ - by_kind[:, 5]
    of = lambda k: by_kind[:, k] / bytes_
    root = np.sqrt
    return np.column_stack([
        np.log1p(n_words), np.log1p(dense / np.maximum(n_words, 1)), of(1), root(of(3)), root(of(0)), root(of(4)),
        root(of(2)), root(of(6)), variety, line_variety, np.log1p(bytes_ / np.maximum(n_lines, 1)),
        odd_words / np.maximum(n_words, 1), root(top), entropy])


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``statistics``, an array of doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                stats = statistics(piece.column(text))
                values = pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * stats.shape[1], stats.ravel())
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], values], [*keep, "statistics"])

    slim = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema)
    return in_arrow(slim, run, f"{fields}, statistics array<double>")


@dataclass
class Discriminant:
    means: np.ndarray      # class, statistic
    factors: np.ndarray    # class, lower Cholesky factor
    log_shares: np.ndarray

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
        return -0.5 * (z * z).sum(0) - np.log(np.diag(self.factors[k])).sum() + self.log_shares[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.log_shares).all():  # one class only, or none
            return np.full(len(x), 0.5 if np.isinf(self.log_shares).all() else float(np.isfinite(self.log_shares[1])))
        gap = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(samples: DataFrame, shrink: float = 0.1, ridge: float = 1e-4) -> Discriminant:
    """``samples``: statistics and label (0 or 1).  Covariances: (1 - shrink) of the class, shrink of the pooled one;
    then the same share of the off-diagonal part goes, and ``ridge`` times the mean variance comes on the diagonal."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column("label").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    part = x[y == k]
                    total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)),
                                          pa.array(total[k, at])], ["k", "at", "v"])

    rows = samples.select("statistics", F.col("label").cast("int").alias("label")).filter("label in (0, 1)") \
        .mapInArrow(sums, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for k, at, v in rows:
        total[k, at] = v
    n = total[:, 0]
    means = total[:, 1:1 + d] / np.maximum(n, 1)[:, None]
    scatter = total[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / max(n.sum() - 2, 1)
    factors = []
    for k in (0, 1):
        cov = (1 - shrink) * scatter[k] / max(n[k] - 1, 1) + shrink * pooled
        diagonal = np.diag(np.diag(cov))
        cov = (1 - shrink) * cov + shrink * diagonal + (ridge * np.trace(cov) / d + 1e-9) * np.eye(d)
        factors.append(np.linalg.cholesky(cov))
    with np.errstate(divide="ignore"):
        return Discriminant(means, np.array(factors), np.log(n / max(n.sum(), 1)))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` with score (probability of class 1) in place of the statistics."""
    keep = [c for c in stats.columns if c not in ("statistics", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(model.score(x))], [*keep, "score"])

    fields = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(stats, run, f"{fields}, score double")


def learned(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", fold: int = 3,
            held: int = 1) -> Discriminant:
    """Fitted on the labelled rows whose crc32 of the key, modulo ``fold``, isn't ``held``."""
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key), F.col(label).alias("label"))
    return fit(stats.filter(crc32_of(key) % fold != held).join(known, key))


def accepted(df: DataFrame, model: Discriminant, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is at least ``least``, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                yield piece.filter(pa.array(model.score(statistics(piece.column(text))) >= least))

    return in_arrow(df, run, df.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = learned(stats, table(spark, sf_dir, "labels"))
    return scored(stats, model).select(
        "doc_id", F.coalesce(crc32_of("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
