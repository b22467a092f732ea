"""Language of texts by a string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams of one, two and three bytes (lower case, runs of ASCII non-letters read as blanks),
hashed into ``DIMS`` places.  The kernel of two texts is the mean over the three lengths of the common places,
each divided by the root of the sizes of both sets.  Landmarks are training texts of every language, chosen by a hash
of the row's id; the regression is fitted in the space they span, from sums of products that
executors accumulate.  Scores of a batch are two matrix products.

Bounds: ``landmarks`` texts in all and about ``sample`` training rows in all, an equal number of each language, are read for
the fit; only the landmarks' sets (not their texts) and the sums come to the driver.  Every row is scored, whole.

Edge cases: NULL text or text without a letter is ``und`` with score 0; NULL languages are no evidence; ties go
to the first language in code point order; without training rows all is ``und``; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tabloom.llm.common import crc32_of, pieces, raw_bytes, table

DIMS = (256, 2048, 4096)
STARTS = (0, 256, 2304)
WIDTH = sum(DIMS)
ROWS = 512  # texts in a matrix product


def _read_as() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        out[b] = b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    return out


READ_AS = _read_as()


def presence(texts: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed n-grams it has."""
    raw, offsets = raw_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(texts)
    x = np.zeros(n * WIDTH, np.float32)
    b = READ_AS[raw].astype(np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(offsets))
    x[row + b] = 1
    two = b[:-1] << 8 | b[1:]
    same = row[:-1] == row[1:]
    x[(row[:-1] + STARTS[1] + ((two * 40503 & 0xFFFFFF) >> 8) % DIMS[1])[same]] = 1
    if len(b) > 2:
        three = two[:-1] << 8 | b[2:]
        same = row[:-2] == row[2:]
        x[(row[:-2] + STARTS[2] + ((three * 2654435761 & 0xFFFFFFFF) >> 8) % DIMS[2])[same]] = 1
    return x.reshape(n, WIDTH)


def normed(x: np.ndarray) -> np.ndarray:
    for start, dim in zip(STARTS, DIMS):
        part = x[:, start:start + dim]
        part /= np.sqrt(len(DIMS) * np.maximum(part.sum(1, keepdims=True), 1))
    return x


@dataclass
class KernelRidge:
    languages: list[str]
    landmarks: np.ndarray  # landmark, place: normed
    weights: np.ndarray    # landmark, language

    def decide(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        n = len(texts)
        best, value = np.full(n, -1), np.zeros(n)
        if self.languages:
            for i in range(0, n, ROWS):
                f = normed(presence(texts.slice(i, ROWS))) @ self.landmarks.T @ self.weights
                best[i:i + ROWS], value[i:i + ROWS] = f.argmax(1), f.max(1)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        none = ~letters | (best < 0)
        names = pa.array([*self.languages, "und"]).take(pa.array(np.where(none, len(self.languages), best)))
        return names, np.where(none, 0.0, np.clip((1 + value) / 2, 0, 1))


def train(docs: DataFrame, landmarks: int = 128, sample: int = 16384, ridge: float = 1e-4, key: str = "doc_id",
          text: str = "text", lang: str = "lang") -> KernelRidge:
    """Fitted on ``docs`` whose language and text aren't NULL."""
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(7)).alias("draw"))
    counts = dict(sorted((r[0], r[1]) for r in docs.groupBy("lang").count().collect()))
    languages = list(counts)
    if not languages:
        return KernelRidge([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0)))
    each = max(1, landmarks // len(languages))
    first = W.partitionBy("lang").orderBy("draw")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(p.astype(np.uint8)).tobytes()
                    for i in range(0, batch.num_rows, ROWS) for p in presence(batch.column("text").slice(i, ROWS))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(bits, pa.binary())], ["lang", "bits"])

    chosen = docs.select("lang", "draw").withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= each) \
        .groupBy("lang").agg(F.max("draw").alias("last"))
    marks = (docs.join(F.broadcast(chosen), "lang").filter(F.col("draw") <= F.col("last")).select("lang", "text")
             .mapInArrow(sets, "lang string, bits binary").collect())
    marks = sorted({(r[0], bytes(r[1])) for r in marks})
    k_marks = normed(np.array([np.unpackbits(np.frombuffer(b, np.uint8))[:WIDTH] for _, b in marks], np.float32))
    # Nystroem: features k(x, marks) R with R the inverse root of the landmarks' own kernel.
    gram = (k_marks @ k_marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    m, names = root.shape[1], {x: i for i, x in enumerate(languages)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b, n = np.zeros((m, m)), np.zeros((m, len(names))), 0
        for batch in batches:
            for piece in pieces(batch):
                for i in range(0, piece.num_rows, ROWS):
                    part = piece.slice(i, ROWS)
                    phi = normed(presence(part.column("text"))) @ k_marks.T @ root
                    y = np.full((len(phi), len(names)), -1.0)
                    y[np.arange(len(phi)), [names[x] for x in part.column("lang").to_pylist()]] = 1
                    g, b, n = g + phi.T @ phi, b + phi.T @ y, n + len(phi)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([b.tobytes()]), pa.array([n])], ["g", "b", "n"])

    # The rows of a language that the sample takes: those with the smallest draws, by rate.
    rate = F.lit(0.0)
    for name, count in counts.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, sample / len(languages) / count))).otherwise(rate)
    drawn = docs.filter(F.pmod("draw", F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text").repartition(8)
    parts = drawn.mapInArrow(sums, "g binary, b binary, n long").collect()
    g = sum(np.frombuffer(r[0]).reshape(m, m) for r in parts)
    b = sum(np.frombuffer(r[1]).reshape(m, len(names)) for r in parts)
    weights = np.linalg.solve(g + ridge * max(sum(r[2] for r in parts), 1) * np.eye(m), b)
    return KernelRidge(languages, k_marks, (root @ weights).astype(np.float32))


def predicted(df: DataFrame, model: KernelRidge, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score."""
    handle = df.sparkSession.sparkContext.broadcast(model)  # landmarks x places at most: 128 x 6400 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                names, scores = handle.value.decide(piece.column(text))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], names, pa.array(scores)],
                                                 [*keep, "lang_pred", "score"])

    slim = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema)
    return slim.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc32_of("doc_id") % 3 != 1))
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc32_of("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred",
                      "score")
