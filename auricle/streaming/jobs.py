"""Continuous intake, counts, windows, timeouts and deduplication."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from auricle import schemas
from auricle.operators import features, intake, metrics
from auricle.schemas import Limits
from auricle.shared import finished_batches


def stream_audio_corpus(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Clips as they arrive."""
    return spark.readStream.format("binaryFile").schema(schemas.CLIPS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)


def stream_request_facts(spark: SparkSession, path: str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Request facts as they arrive."""
    return spark.readStream.schema(schemas.REQUEST_FACTS).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_intake(clips: DataFrame, valid_path: str, reject_path: str, checkpoint: str, limits: Limits | None = None) -> StreamingQuery:
    """Gates arriving clips and writes each batch's valid rows and rejects under ``batch=<id>``.

    Clips without a column ``n_samples`` get it from their own content, where that is WAV; others count as not decoded.

    Each clip ends up in one of the two exactly once. A batch that fails before its checkpoint is run again with the same clips
    and the same id. Rejects are written last and complete it: without them, both folders are overwritten; with them, nothing
    is written again. ``read_intake`` reads complete batches only, so it never sees a clip's batch in one sink alone.
    """
    spark = clips.sparkSession

    def route(batch: DataFrame, batch_id: int) -> None:
        if batch_id in finished_batches(spark, reject_path):
            return
        counted = batch if "n_samples" in batch.columns else features.count_wav_samples(batch)
        gated = intake.gate(intake.with_format(counted), limits).persist()  # both sinks' writes read it
        try:
            valid, rejects = intake.split_by_outcome(gated)
            _write_batch(valid.drop("outcome"), valid_path, batch_id)
            _write_batch(rejects.drop("content"), reject_path, batch_id)
        finally:
            gated.unpersist()

    return clips.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_intake(spark: SparkSession, valid_path: str, reject_path: str) -> tuple[DataFrame, DataFrame] | None:
    """(valid, rejects) of the batches that ``stream_intake`` has completed, with their ``batch``; None before the first."""
    done = sorted(finished_batches(spark, reject_path))
    if not done:
        return None
    read = lambda path: spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in done])
    return read(valid_path), read(reject_path)


def stream_requests_total(facts: DataFrame) -> DataFrame:
    """Running counts by status and language, for update or complete mode."""
    return metrics.requests_total(facts)


def stream_windowed(facts: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and cumulative duration buckets per status in tumbling or sliding windows; rows later than ``delay`` are dropped."""
    rows = facts.withWatermark("arrival", delay) if facts.isStreaming else facts
    span = F.window("arrival", size, slide) if slide else F.window("arrival", size)
    took = F.col("decode_s") + F.col("inference_s")
    buckets = [F.count_if(took <= b).alias(f"le_{str(b).replace('.', '_')}") for b in metrics.REQUEST_BUCKETS]
    return rows.groupBy(span.alias("w"), "status").agg(F.count("*").alias("requests"), *buckets).select(F.col("w.start").alias("window_start"), "status", "requests", *(f"le_{str(b).replace('.', '_')}" for b in metrics.REQUEST_BUCKETS))


def stream_timeouts(starts: DataFrame, ends: DataFrame, timeout_s: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Requests (request_id, started) without an end (request_id, ended) within the timeout.

    On streams an unmatched request comes out once the watermark has passed its timeout.
    """
    s, e = starts.select("request_id", "started"), ends.select(F.col("request_id").alias("end_id"), "ended")
    if s.isStreaming:
        s, e = s.withWatermark("started", delay), e.withWatermark("ended", delay)
    within = (F.col("request_id") == F.col("end_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {timeout_s} seconds"))
    return s.join(e, within, "leftOuter").where("end_id is null").select("request_id", "started")


#: State store that timers and lists of state need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class EarliestRecord(StatefulProcessor):
    """Keeps the earliest record of a key, and gives it when no copy of it can arrive any more.

    A record within the delay of a kept one is its copy and stays only if it is earlier; one further off is a record of its own. State is a
    row a kept record, and an event-time timer each.
    """

    def __init__(self, columns: list[str], time: str, schema: StructType, delay_us: int) -> None:
        self.columns, self.time, self.schema, self.delay_us = columns, time, schema, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)

    def _us(self, row: tuple) -> int:
        at = row[self.columns.index(self.time)]
        return round(at.timestamp() * 1_000_000)

    def _rank(self, row: tuple) -> tuple:
        return self._us(row), tuple((v is not None, str(v)) for v in row)

    def _due_ms(self, row: tuple) -> int:
        return -(-(self._us(row) + self.delay_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(r) for r in self.kept.get()]
        kept: list[tuple] = []
        for row in heapq.merge(sorted(before, key=self._rank), sorted((tuple(r[c] for c in self.columns) for r in rows), key=self._rank), key=self._rank):
            if not kept or self._us(row) - self._us(kept[-1]) > self.delay_us:
                kept.append(row)
        if kept != before:
            for due in {self._due_ms(r) for r in before} - {self._due_ms(r) for r in kept}:
                self.handle.deleteTimer(due)
            for due in {self._due_ms(r) for r in kept} - {self._due_ms(r) for r in before}:
                self.handle.registerTimer(due)
            self.kept.put(kept)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        kept = [tuple(r) for r in self.kept.get()]
        later = [r for r in kept if self._due_ms(r) > due]
        if later:
            self.kept.put(later)
        else:
            self.kept.clear()
        return iter([Row(**dict(zip(self.columns, r, strict=True))) for r in kept if self._due_ms(r) <= due])

    def close(self) -> None:
        pass


def stream_dedupe(records: DataFrame, time: str = "time", delay: str = "10 minutes", key: str = "request_id") -> DataFrame:
    """The earliest record of each ``key``, whole; of records at one time, the one whose values come first as text.

    On a stream, records within ``delay`` of each other are copies, and the earliest comes out once the watermark has passed it by ``delay``,
    so copies that arrive late but within the watermark count, later ones are dropped. Records without a time
    are dropped there. The stream needs the state store of ``ROCKSDB``. On a batch all records of a key are copies.
    """
    if not records.isStreaming:
        shown = F.struct(F.col(time).isNull(), time, *[F.struct(F.col(c).isNotNull(), F.col(c).cast("string")) for c in records.columns])
        return records.groupBy(key).agg(F.min_by(F.struct(*records.columns), shown).alias("r")).select("r.*")
    span = records.sparkSession.sql(f"SELECT CAST(unix_micros(timestamp_seconds(0) + INTERVAL {delay}) AS BIGINT)").first()[0]
    keep = EarliestRecord(records.columns, time, records.schema, span)
    rows = records.where(F.col(time).isNotNull()).withWatermark(time, delay)
    return rows.groupBy(key).transformWithState(keep, records.schema, "Append", "EventTime")
