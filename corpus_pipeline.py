"""Corpus pipeline: filters, dedupes, decontaminates and redacts documents, then mixes them.

Each stage gets what the one before it kept, as a table that was written and read again, and
returns the columns of documents; the last returns the mixture: those columns, the domain that
the row was drawn for, and its epoch (a document comes once per epoch it is in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import contamination, mixing, pii, simhash, toxicity
from shelfspark.llm.text import table
from shelfspark.session import delete, new_path, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold, repeated ones included; null and empty texts stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per group of texts whose SimHash fingerprints of three-word shingles differ in at most two bits; null and empty texts are one group."""
    return simhash.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark, repeated ones included; null and empty texts stay."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mixture, once per epoch, with `mix_domain` and `mix_epoch`; columns of these names in the input are replaced.

    A null language or source is the leaf `unknown`; repeated rows go together; texts without words count no tokens.
    """
    names = [c for c in docs.columns if c not in ("mix_domain", "mix_epoch")]
    return mixing.mix(docs).select(*[f"row.`{c}`" for c in names], mixing.F.col("domain").alias("mix_domain"), mixing.F.col("epoch").alias("mix_epoch"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("pii", redact),
    ("mixing", mix),
]

# model fits, repeated pattern scoring and component search have no SQL form; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes when its result is written, the result when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return docs
