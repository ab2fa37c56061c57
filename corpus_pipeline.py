"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokenization.

Every stage works on all rows it is given. Null and empty texts are ordinary documents, of one group in the
near-copy stage; null ids, sources and other columns pass through; rows repeated in full are copies
of each other; texts of any length are read whole; an empty table stays empty. Further columns of any
name are kept as they are, but for ids and n_ids, which the last stage gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.llm import mixing, pii, simhash, toxicity, unigram
from auricle.llm.common import fresh

#: Sources weigh as their size times these, repeating by name. Whatever the sizes, at 150 % of the words
#: each source is then taken between once and twice, so mixing repeats documents but loses none.
TILT = (4, 3, 3)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score THRESHOLD or more; without confirmed toxic labels none is rejected."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "score")
    return toxicity.score_documents(spark, docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that of smallest (doc_id, text hash), nulls last. Ties are rows repeated in full, of which one stays."""
    return simhash.one_per_group(spark, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and n_chars to match; texts without any stay as they are."""
    return pii.redact_personal_data(spark, docs)


def tilted(sources: DataFrame) -> DataFrame:
    """(key, size) with weight: the size times TILT, so that every source is taken once to twice."""
    return mixing.repeating_weights(sources, TILT).withColumn("weight", F.col("weight") * F.greatest(F.col("size"), F.lit(1)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the sources come near their target weights. Each is taken once or twice; null sources are one source; rows equal in id and text are taken alike."""
    return mixing.mix_documents(spark, docs, tilted)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: the columns of documents without the text, n_ids, ids (columns of these names are replaced). Null and empty texts give no ids."""
    return unigram.encode_documents(spark, docs)


#: Rows that go to a Python worker at a time, as they hold whole texts; Spark's default of 10,000 keeps tens of MB a task on either side.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with BATCH_ROWS at most in the session's Arrow batches, from now on: Spark reads the setting when the result is written."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(BATCH_SETTING))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return call


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("simhash_dedup", in_small_batches(drop_near_duplicates)),
    ("personal_data", in_small_batches(redact_personal_data)),
    ("mix_sources", in_small_batches(mix_sources)),
    ("sentencepiece", in_small_batches(encode)),
]

#: Trained and iterative stages have no SQL form; tests check them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
