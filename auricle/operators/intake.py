"""Intake: labelling clips, the accept/reject gate, manifests and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.audio import DECODED_BYTE_CAP, MAX_PAYLOAD_SAMPLES, MIN_SAMPLES, clip_duration, fixed_decimals, sniff_format
from auricle.functions.labels import error_envelope
from auricle.schemas import Limits

SAMPLE_RATE = 16_000
BAD_REQUEST = "invalid_request_error"


def with_format(clips: DataFrame) -> DataFrame:
    """``clips`` with ``format``."""
    return clips.withColumn("format", sniff_format(F.col("content")))


def format_profile(clips: DataFrame) -> DataFrame:
    """Clips and bytes per detected format; ``accepted`` tells known formats from the rest."""
    return clips.groupBy(F.coalesce("format", F.lit("unknown")).alias("format"), F.col("format").isNotNull().alias("accepted")).agg(F.count("*").alias("clips"), F.sum("length").alias("bytes"))


def outcome(code: int, kind: str | None, message: Column | str | None) -> Column:
    text = F.lit(message) if isinstance(message, str | None) else message
    return F.struct(F.lit(code).alias("code"), F.lit(kind).cast("string").alias("type"), text.cast("string").alias("message"))


def intake_outcome(limits: Limits, sample_rate: int = SAMPLE_RATE) -> Column:
    """struct(code, type, message) of the first gate that a clip fails, or code 200.

    Uses the columns malformed (boolean), has_file, readable, length, format, n_samples
    (null: the decoder failed) and inferred (boolean: recognition succeeded).
    """
    duration = clip_duration(F.col("n_samples"), sample_rate)
    bad = lambda message: outcome(400, BAD_REQUEST, message)
    too_long = F.concat(F.lit("audio duration "), fixed_decimals(duration, 0), F.lit(f"s exceeds limit of {limits.max_audio_s}s"))
    return (
        F.when(F.col("length") > limits.max_file_size_mb * 2**20, bad(f"file size exceeds maximum of {limits.max_file_size_mb} MB"))
        .when(F.col("malformed"), bad("invalid request body"))
        .when(~F.col("has_file"), bad("missing 'file' field"))
        .when(~F.col("readable"), bad("file too large or unreadable"))
        .when(F.col("format").isNull(), bad("audio decode failed: unsupported audio format"))
        .when(F.col("n_samples") * 2 > DECODED_BYTE_CAP, bad("audio decode failed: decoded audio exceeds maximum size"))
        .when(F.coalesce(F.col("n_samples"), F.lit(0)) < 1, bad("audio decode failed: no audio"))
        .when(F.col("n_samples") < MIN_SAMPLES, bad("audio too short (minimum 100ms required)"))
        .when(duration > limits.max_audio_s, outcome(413, BAD_REQUEST, too_long))
        .when(~F.col("inferred"), outcome(408, BAD_REQUEST, "transcription timed out"))
        .otherwise(outcome(200, None, None))
    )


def gate(clips: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``clips`` with ``outcome``; the columns the gate knows nothing of get their accepting value."""
    for name, accepting in (("malformed", False), ("has_file", True), ("readable", True), ("inferred", True)):
        if name not in clips.columns:
            clips = clips.withColumn(name, F.lit(accepting))
    return clips.withColumn("outcome", intake_outcome(limits or Limits()))


def split_by_outcome(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); rejects carry the JSON error body."""
    ok = F.col("outcome.code") == 200
    return gated.where(ok), gated.where(~ok).withColumn("body", error_envelope(F.col("outcome.message"), F.col("outcome.type"), F.col("outcome.code")))


def payload_outcome(length: Column, sample_rate: Column, samples: Column) -> Column:
    """Message of the first check that packed 32-bit samples fail, or null.

    ``samples`` is the unpacked array, for the test of non-finite values.
    """
    return (
        F.when(length % 4 != 0, F.lit("samples must be float32 aligned (multiple of 4 bytes)"))
        .when(length == 0, F.lit("empty audio"))
        .when(sample_rate <= 0, F.lit("sample_rate must be positive"))
        .when(F.floor(length / 4) > MAX_PAYLOAD_SAMPLES, F.lit("audio exceeds maximum of 600 seconds"))
        .when(F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("audio contains non-finite values"))
    )


def attach_manifest(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    """Manifest rows with their clip; ``has_file`` is false where there is none."""
    clips = corpus.withColumn("has_file", F.lit(True))
    return manifest.join(clips, "path", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))


def pending_clips(corpus: DataFrame, done: DataFrame) -> DataFrame:
    """Clips of which this version (path and modification time) is not in ``done``."""
    return corpus.join(done.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
