"""Log records and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.functions.labels import LEVELS, level_rank


def filter_level(records: DataFrame, level: str) -> DataFrame:
    """Records at or above ``level``; empty means info; records of unknown level are dropped."""
    if level not in (*LEVELS, ""):
        raise ValueError(f"records have the levels {', '.join(LEVELS)}, not {level!r}")
    return records.where(level_rank(F.col("level")) >= LEVELS[level or "info"])


def union_log_records(ok: DataFrame, errors: DataFrame) -> DataFrame:
    """Success and error records in one table; fields of the other kind are null."""
    return ok.unionByName(errors, allowMissingColumns=True)


def logs_with_spans(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Log records with their root span's times, by trace."""
    roots = spans.where("parent_id is null or parent_id = ''").select("trace_id", F.col("start_ts").alias("root_start"), F.col("end_ts").alias("root_end"))
    return logs.join(roots, "trace_id", "left")


def span_breakdown(spans: DataFrame) -> DataFrame:
    """Per trace in microseconds: total of the root span, decoding, inference and the rest. One grouping, no join."""
    us = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    named = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, us)), F.lit(0))
    rows = spans.groupBy("trace_id").agg(F.max(F.when(F.col("name") == "transcribe", us)).alias("total_us"), named("audio.decode").alias("decode_us"), named("model.inference").alias("inference_us"))
    return rows.withColumn("other_us", F.col("total_us") - F.col("decode_us") - F.col("inference_us"))
