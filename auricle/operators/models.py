"""Audits over inventories of model files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ONNX_BYTES = 2**20
SENSE_VOICE = "sense_voice|sensevoice|SenseVoice"
PARAFORMER = "paraformer|Paraformer"


def _has(prefix: str) -> F.Column:
    return F.bool_or(F.col("file").isin(f"{prefix}.onnx", f"{prefix}.int8.onnx"))


def _best(prefix: str) -> F.Column:
    """The int8 file if there is one, else the full-precision one."""
    return F.min_by("file", F.when(F.col("file") == f"{prefix}.int8.onnx", F.lit(0)).when(F.col("file") == f"{prefix}.onnx", F.lit(1)))


def model_type_of(inventory: DataFrame) -> DataFrame:
    """(model_dir, model_type, encoder, model): type by the files a directory has and its name; null if none fits."""
    rows = inventory.groupBy("model_dir").agg(
        F.bool_or(F.col("file") == "tokens.txt").alias("tokens"),
        *(_has(p).alias(f"has_{p}") for p in ("encoder", "decoder", "joiner", "model")),
        _best("encoder").alias("encoder"),
        _best("model").alias("model"),
    )
    pair = F.col("has_encoder") & F.col("has_decoder")
    kind = (
        F.when(~F.col("tokens"), None)
        .when(pair & F.col("has_joiner"), "nemo_transducer")
        .when(pair, "whisper")
        .when(F.col("has_model") & F.col("model_dir").rlike(SENSE_VOICE), "sense_voice")
        .when(F.col("has_model") & F.col("model_dir").rlike(PARAFORMER), "paraformer")
        .when(F.col("has_model"), "nemo_ctc")
    )
    return rows.select("model_dir", kind.alias("model_type"), "encoder", "model")


def model_integrity(inventory: DataFrame) -> DataFrame:
    """(model_dir, ok, reason): tokens.txt there and not empty; at least one .onnx file; each of 1 MiB or more and starting with byte 08."""
    onnx = F.col("file").endswith(".onnx")
    token_bytes = F.max(F.when(F.col("file") == "tokens.txt", F.col("length")))
    small = F.min(F.when(onnx & (F.col("length") < MIN_ONNX_BYTES), F.col("file")))
    wrong = F.min(F.when(onnx & (F.coalesce(F.hex(F.substring("head", 1, 1)), F.lit("")) != "08"), F.col("file")))
    rows = inventory.groupBy("model_dir").agg(token_bytes.alias("t"), F.count_if(onnx).alias("n"), small.alias("small"), wrong.alias("wrong"))
    reason = (
        F.when(F.col("t").isNull(), F.lit("tokens.txt not found"))
        .when(F.col("t") == 0, F.lit("tokens.txt is empty"))
        .when(F.col("small").isNotNull(), F.concat(F.lit("file is suspiciously small: "), F.col("small")))
        .when(F.col("wrong").isNotNull(), F.concat(F.lit("file has an invalid header: "), F.col("wrong")))
        .when(F.col("n") == 0, F.lit("no ONNX model files found"))
    )
    return rows.select("model_dir", reason.isNull().alias("ok"), reason.alias("reason"))


def artifact_checksum(files: DataFrame) -> DataFrame:
    """(model_dir, file, sha256) of files with content."""
    return files.select("model_dir", "file", F.sha2("content", 256).alias("sha256"))


def checksum_status(checksums: DataFrame, pins: DataFrame) -> DataFrame:
    """``checksums`` (model_dir, file, sha256) with status: match, mismatch (to reject) or unpinned (to warn about)."""
    known = pins.select("model_dir", "file", F.lower("sha256").alias("pinned"))
    status = F.when(F.col("pinned").isNull(), "unpinned").when(F.col("pinned") == F.lower("sha256"), "match").otherwise("mismatch")
    return checksums.join(known, ["model_dir", "file"], "left").withColumn("status", status).drop("pinned")
