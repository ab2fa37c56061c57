"""Writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions.labels import sanitize_lang
from auricle.operators.intake import pending_clips
from auricle.shared import finished_batches


def write_transcripts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Transcripts as Parquet by sanitized language (27 values at most) and ingest date.

    ``df`` has ``language``, and whatever else is to be stored with the text: the arrays words and segments, a rendered body.
    ``ingest_date`` is added as today where missing. Rows are rebalanced by language and date, so folders get
    few files, while Spark splits a common language among many writers.
    """
    dated = df if "ingest_date" in df.columns else df.withColumn("ingest_date", F.current_date())
    labelled = dated.withColumn("lang", sanitize_lang(F.col("language")))
    labelled.hint("rebalance", "lang", "ingest_date").write.mode(mode).partitionBy("lang", "ingest_date").parquet(path)


def write_rejects(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rejected rows as Parquet by error code (``outcome.code``)."""
    df.withColumn("code", F.col("outcome.code")).hint("rebalance", "code").write.mode(mode).partitionBy("code").parquet(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame | None:
    """All transcripts of the batches under ``path`` that were written to their end, with ``batch``; None before the first."""
    done = finished_batches(spark, path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in sorted(done)]) if done else None


def write_pending(corpus: DataFrame, path: str, transcribe: Callable[[DataFrame], DataFrame]) -> int | None:
    """Transcribes the clips of ``corpus`` (path, modificationTime) that no finished batch has, as a batch of its own; its number, or None if there are none.

    ``transcribe`` keeps path and modificationTime and gives ``language``. Running again changes nothing, and
    runs on from where a run has failed: a batch counts once it is written to its end, an unfinished one is overwritten whole, whatever folders it
    has left behind. One run at a time.
    """
    spark = corpus.sparkSession
    done = read_transcripts(spark, path)
    pending = corpus if done is None else pending_clips(corpus, done)
    if pending.isEmpty():
        return None
    batch = max(finished_batches(spark, path), default=-1) + 1
    write_transcripts(transcribe(pending), f"{path}/batch={batch}", "overwrite")
    return batch
