"""Queries of text columns as features, with equivalent SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.operators.tokens import SLOTS, TextFeatures, chi_square, counting_stages
from tabloom.sources.tables import load_table

KEEP = 200


def _texts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All documents; those with a label."""
    docs = load_table(spark, sf, "documents", ["doc_id", "text"])
    labels = load_table(spark, sf, "labels", ["doc_id", "quality"])
    return docs, docs.join(labels.filter("quality is not null"), "doc_id")


def chi_square_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Each slot that a labelled document has: its documents and its statistic."""
    _, known = _texts(spark, sf)
    counted = PipelineModel(counting_stages("text")).transform(known)
    return chi_square(counted, "text_counts", "quality").select("slot", "n_docs", F.round("chi2", 6).alias("chi2"))


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's kept slots and the sum of their weights."""
    docs, known = _texts(spark, sf)
    model = TextFeatures("text", "quality", keep=KEEP).fit(known)
    values = F.unwrap_udt("text_text").getField("values")
    return model.transform(docs).select(
        "doc_id", F.size(F.filter(values, lambda x: x != 0)).cast("long").alias("n_slots"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 6).alias("weight"))


_WORD = 1 << 32


def _turn(x: str, bits: int) -> str:
    return f"(({x}) * {1 << bits} % {_WORD} + ({x}) // {1 << (32 - bits)})"


def _scatter(x: str) -> str:
    turned = _turn(f"({x}) * 3432918353 % {_WORD}", 15)
    return f"({turned} * 461845907 % {_WORD})"


# The hash of a token is MurmurHash3 (32 bits, seed 42) of its bytes, modulo the number of slots.
_COUNTS_SQL = f"""
  toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok FROM documents),
  bytes AS (SELECT tok, length(tok) AS n,
                   list_transform(range(1, length(tok) + 1), lambda i: ascii(substr(tok, i, 1))::HUGEINT) AS b
            FROM (SELECT DISTINCT tok FROM toks)),
  blocks AS (SELECT tok, n,
      list_transform(range(n // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS k,
      (CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN b[n] WHEN 2 THEN b[n - 1] + b[n] * 256
                  ELSE b[n - 2] + b[n - 1] * 256 + b[n] * 65536 END)::HUGEINT AS rest FROM bytes),
  reduced AS (SELECT tok, n, rest, list_reduce(list_prepend(42::HUGEINT, list_transform(k, lambda x: {_scatter('x')})),
      lambda h, x: ({_turn('xor(h, x)', 13)} * 5 + 3864292196) % {_WORD}) AS h FROM blocks),
  ended AS (SELECT tok, xor(xor(h, {_scatter('rest')}), n::HUGEINT) AS h FROM reduced),
  first AS (SELECT tok, xor(h, h // 65536) * 2246822507 % {_WORD} AS h FROM ended),
  second AS (SELECT tok, xor(h, h // 8192) * 3266489909 % {_WORD} AS h FROM first),
  slots AS (SELECT tok, (xor(h, h // 65536) % {SLOTS})::INTEGER AS slot FROM second),
  counts AS (SELECT doc_id, slot, count(*) AS tf FROM toks JOIN slots USING (tok) GROUP BY ALL),
  known AS (SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
  totals AS (SELECT quality, count(*)::DOUBLE AS t FROM known GROUP BY ALL),
  everything AS (SELECT sum(t) AS n_rows FROM totals),
  cells AS (SELECT slot, quality, count(*) AS o FROM counts JOIN known USING (doc_id) GROUP BY ALL),
  sums AS (SELECT slot, sum(o)::BIGINT AS n_docs, sum(o * o / t) AS q FROM cells JOIN totals USING (quality) GROUP BY slot),
  chi AS (SELECT slot, n_docs, n_rows, CASE WHEN n_docs < n_rows
            THEN n_rows * (n_rows * q - n_docs::DOUBLE * n_docs) / (n_docs * (n_rows - n_docs)) ELSE 0 END AS chi2
          FROM sums, everything)"""

QUERIES = {
    "chi_square_slots": (chi_square_slots, f"WITH {_COUNTS_SQL} SELECT slot, n_docs, round(chi2, 6) AS chi2 FROM chi"),
    "text_features": (text_features, f"""WITH {_COUNTS_SQL},
        best AS (SELECT slot, ln((n_rows + 1) / (n_docs + 1)) AS w FROM chi ORDER BY round(chi2, 6) DESC, slot LIMIT {KEEP}),
        weights AS (SELECT doc_id, count_if(w <> 0) AS n, sum(tf * w) AS weight FROM counts JOIN best USING (slot) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_slots, round(coalesce(weight, 0), 6) AS weight
        FROM documents LEFT JOIN weights USING (doc_id)"""),
}
