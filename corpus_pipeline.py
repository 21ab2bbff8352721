"""Pipeline over the documents table: each stage works on all that its predecessor kept.

Every stage but the last returns the columns of documents. Decisions are taken by doc_id; rows with a null id are never
dropped, and of rows that repeat an id all go when one of them is rejected. Null and empty texts fail the quality rules,
further columns are kept whatever their names, and an empty table gives an empty result at every stage.

A stage keeps only the scratch tables that its result still reads; the others are gone when it returns.

Texts go to the Python workers in batches of a few MB: by Spark's defaults a batch has 10,000 documents, which the
executor and its workers hold several times over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repohealth.llm import decontam, jaccard, packing, quality, suffix
from repohealth.llm.common import remove, scratch, table
from repohealth.llm.queries import vocabulary

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at ``BATCH_BYTES``; rows stay whole."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; texts stay as they are."""
    small_batches(spark)
    return quality.without_rejected(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts, but for their first occurrence; n_chars follows. No document goes."""
    small_batches(spark)
    found = suffix.without_repeats(docs)
    _, removed, _, _, text = found.columns[-5:]
    new = {"text": F.when(F.col("text").isNotNull(), F.col(text)), "n_chars": F.when(F.col(removed) > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long")}
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    small_batches(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, as pieces."""
    small_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", keep_quality), ("n-gram Jaccard join", keep_one_of_each), ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks), ("packing", pack),
]

ORACLE_SQL = None  # token ids and line hashes are beyond SQL; tests/llm/test_pipeline.py has the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written as Parquet and read again as the next one's documents."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove(spark, read)
        read = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
