"""Rendering transcripts: srt, vtt, json, text, verbose_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.timecode import srt_time, vtt_time


def srt_block(s: Column) -> Column:
    return F.concat((s["id"] + 1).cast("string"), F.lit("\n"), srt_time(s["start"]), F.lit(" --> "), srt_time(s["end"]), F.lit("\n"), s["text"], F.lit("\n\n"))


def vtt_block(s: Column) -> Column:
    return F.concat(vtt_time(s["start"]), F.lit(" --> "), vtt_time(s["end"]), F.lit("\n"), s["text"], F.lit("\n\n"))


def srt(segments: Column) -> Column:
    """Of an array of segments in order; none give an empty text."""
    return F.coalesce(F.array_join(F.transform(segments, srt_block), ""), F.lit(""))


def vtt(segments: Column) -> Column:
    """Of an array of segments in order; none give the header only."""
    return F.concat(F.lit("WEBVTT\n\n"), F.coalesce(F.array_join(F.transform(segments, vtt_block), ""), F.lit("")))


def in_order() -> Column:
    """Aggregate: a clip's segments by id."""
    return F.array_sort(F.collect_list(F.struct("id", "start", "end", "text")))


def render_srt(segments: DataFrame) -> DataFrame:
    """(clip_id, srt)"""
    return segments.groupBy("clip_id").agg(in_order().alias("s")).select("clip_id", srt(F.col("s")).alias("srt"))


def render_vtt(segments: DataFrame) -> DataFrame:
    """(clip_id, vtt)"""
    return segments.groupBy("clip_id").agg(in_order().alias("s")).select("clip_id", vtt(F.col("s")).alias("vtt"))


def json_body(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def verbose_json(clip: str = "") -> Column:
    """JSON of duration, language (raw), segments, task, text and words; missing words and segments are absent keys."""
    c = lambda name: F.col(f"{clip}{name}")
    fields = [c("duration").alias("duration"), c("language").alias("language"), c("segments").alias("segments"), F.lit("transcribe").alias("task"), c("text").alias("text"), c("words").alias("words")]
    return F.to_json(F.struct(*fields))


def render_response(clips: DataFrame) -> DataFrame:
    """``clips`` (text, duration, language, words, segments, response_format) with ``body`` in the format asked for; any other gives json."""
    kind = F.col("response_format")
    body = F.when(kind == "text", F.col("text")).when(kind == "verbose_json", verbose_json()).when(kind == "srt", srt(F.col("segments"))).when(kind == "vtt", vtt(F.col("segments")))
    return clips.withColumn("body", body.otherwise(json_body(F.col("text"))))
