"""From documents to packed sequences, in five stages.

1. quality: documents that the classifier rejects go.
2. lines: aligned common blocks go from the later document; documents of which no line is left go.
3. near duplicates: of each group of similar documents (five-word shingles, similarity 0.8 or more) the one with the smallest
   id stays; rows with one id are one document and stay together, rows without an id stay.
4. mixing: documents are taken as often as the target weights of their sources ask; where a run of blocks ends within a
   document, that copy is cut there.
5. packing: documents become pieces of token sequences, and the rows of the last stage are pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  All but the last return the columns
of ``docs``; ``n_chars`` follows a text that a stage changes.  Edge cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import line_dedup, mixing, near_duplicates, packing, quality
from tabloom.llm.common import table, written


def _with_length(df: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learned(quality.with_statistics(docs), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(docs).filter((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    return _with_length(out, docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(mixing.copies(mixing.mixed(docs)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pieces_of(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", keep_quality), ("lines", dedup_lines), ("near_duplicates", dedup_near), ("mixing", mix_sources),
          ("packing", pack)]
#: A classifier and a tokenizer can't be written in SQL.  A test holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
