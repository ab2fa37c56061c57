"""Inputs of the transcript operators, derived from the driver's tables row by row."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions.labels import LANGUAGES
from auricle.operators import engines, features, timing

#: Language values of request facts: the known codes, and three that are not.
FACT_LANGUAGES = (*LANGUAGES, "unknown", "xx", "")
BLANK_ID = 63
CLIP_IDS, CLIP_FACTOR = 400, 1_000_000_000
#: Frames that clips are padded or cut to.
PADDED = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    """A result per document: its words in pieces of four characters, the first with a leading space, 80 ms apart; and ``more`` columns of the document."""
    spaced = F.concat(F.lit(" "), F.regexp_replace("text", "[ \\t\\n\\r]+", " "))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.regexp_extract_all(spaced, F.lit(" ?[^ ]{1,4}"), F.lit(0)).alias("tokens"), *more)
    return rows.withColumn("timestamps", F.transform("tokens", lambda _, i: (i * F.lit(0.08)).cast("float")))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form, a token a row."""
    return timing.explode_tokens(results(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits: a label's vectors among CLIP_IDS successive ids are a clip's frames, in order of id, so clips stay short."""
    clip = F.col("label").cast("bigint") * CLIP_FACTOR + F.expr(f"vec_id div {CLIP_IDS}")
    rows = table(spark, sf_dir, "embeddings").select(clip.alias("clip_id"), "vec_id", "embedding")
    number = F.row_number().over(features.Window.partitionBy("clip_id").orderBy("vec_id")) - 1
    return rows.select("clip_id", number.cast("int").alias("frame"), F.col("embedding").alias("logits"))


def frame_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token per position that the logits have: odd ids plain, even ids with a mark, the last one blank."""
    ids = table(spark, sf_dir, "embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("token_id")).distinct()
    token = F.when(F.col("token_id") == BLANK_ID, "<blk>").when(F.col("token_id") % 2 == 1, F.concat(F.lit("t"), F.col("token_id"))).otherwise(F.concat(F.lit("▁t"), F.col("token_id")))
    return ids.select("token_id", token.alias("token"))


def part_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tokens; every 977th is a blank token."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("token_id"), F.expr("if(p_partkey % 977 = 976, '<blank>', p_name)").alias("token"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms at 16 kHz; one in fifty is empty."""
    x = F.expr("if(vec_id % 50 = 0, cast(array() as array<float>), embedding)")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(16_000).alias("sample_rate"), x.alias("samples"))


def long_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text bytes as 16-bit PCM, packed: a waveform per document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.lit(16_000).alias("sample_rate"), F.col("text").cast("binary").alias("pcm"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text bytes after one of ten headers, by id."""
    header = F.expr("""element_at(array(X'52494646', X'494433', X'664C6143', X'4F676753', X'1A45DFA3', X'0000000066747970', X'FFFB9000', X'FFF15080', X'', X'00'), int(doc_id % 10) + 1)""")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.concat(header, F.col("text").cast("binary")).alias("content"))
    return rows.withColumn("length", F.length("content").cast("bigint"))


def little_endian(number: F.Column, size: int) -> F.Column:
    """A number as so many bytes, lowest first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def wav_clips(docs: DataFrame) -> DataFrame:
    """Documents as WAV clips (clip_id, path, content, length), their text bytes as 16-bit PCM, in one of six makes by id:

    plain; after a chunk of odd size; with a longer format chunk; stereo; cut short of the size it states; behind an MP3 header instead.
    """
    data, tag = F.col("text").cast("binary"), lambda name: F.lit(name.encode())
    size = F.coalesce(F.length(data), F.lit(0))

    def format_chunk(channels: int, more: bytes = b"") -> F.Column:
        head = b"".join(n.to_bytes(w, "little") for n, w in ((16 + len(more), 4), (1, 2), (channels, 2), (16_000, 4), (32_000 * channels, 4), (2 * channels, 2), (16, 2)))
        return F.lit(b"fmt " + head + more)

    chunk = lambda stated: F.concat(tag("data"), little_endian(stated, 4), data)
    riff = lambda *parts: F.concat(tag("RIFF"), little_endian(size + 36, 4), tag("WAVE"), *parts)
    odd = F.lit(b"LIST" + (5).to_bytes(4, "little") + b"notes\0")
    makes = [
        riff(format_chunk(1), chunk(size)),
        riff(odd, format_chunk(1), odd, chunk(size)),
        riff(format_chunk(1, b"\0\0"), chunk(size)),
        riff(format_chunk(2), chunk(size)),
        riff(format_chunk(1), chunk(size + 1000)),
        F.concat(tag("ID3"), data),
    ]
    content = makes[5]
    for i, make in enumerate(makes[:5]):
        content = F.when(F.col("doc_id") % 6 == i, make).otherwise(content)
    rows = docs.select(F.col("doc_id").alias("clip_id"), F.concat(F.lit("clip/"), F.col("doc_id")).alias("path"), content.alias("content"))
    return rows.withColumn("length", F.length("content").cast("bigint"))


#: Clips whose sample count this divides stall the engine below.
STALLS = 211


class StallingEngine(engines.EchoEngine):
    """Echo, which never answers on some clips and fails on others."""

    def transcribe(self, samples, sample_rate: int) -> dict:
        while len(samples) % STALLS == 0:
            time.sleep(60)
        if len(samples) % STALLS == 1:
            raise ValueError("not in the mood")
        return super().transcribe(samples, sample_rate)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "events"))


def facts_of(events: DataFrame) -> DataFrame:
    """Events as request facts."""
    langs = F.array(*map(F.lit, FACT_LANGUAGES))
    n = len(FACT_LANGUAGES)
    status = F.expr("case when event_type = 'error' or value < 0.1 then 400 when value > 300 then 413 when event_id % 97 = 0 then 408 when event_id % 89 = 0 then 429 else 200 end")
    return events.select(
        F.concat(F.lit("req-"), F.col("event_id")).alias("request_id"),
        F.col("ts").cast("timestamp").alias("arrival"),
        F.expr("double(event_id % 5)").alias("queue_s"),
        (F.col("value") / 1000).alias("decode_s"),
        (F.col("value") / 100).alias("inference_s"),
        F.col("value").alias("duration_s"),
        F.expr("(event_id % 1000 + 1) * 1000").alias("size_bytes"),
        F.round(F.col("value") * 16000).cast("bigint").alias("n_samples"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.element_at(langs, (F.col("user_id") % n).cast("int") + 1)).alias("model_lang"),
        F.element_at(langs, (F.col("event_id") % n).cast("int") + 1).alias("hint"),
        status.alias("status"),
        F.col("event_id"),
    )


def log_fields(rows: DataFrame) -> DataFrame:
    """Facts as log records' fields: success and error records; rejected requests (429) are not logged."""
    from auricle.functions.audio import fixed_decimals
    from auricle.operators.metrics import with_lang

    ok = F.col("status") == 200
    ms = lambda c: F.floor(c * 1000).cast("bigint")
    return with_lang(rows.where("status <> 429")).select(
        F.col("arrival").alias("time"),
        F.when(ok, "INFO").when(F.col("status") == 408, "WARN").otherwise("ERROR").alias("level"),
        F.when(ok, "transcribed").otherwise("request failed").alias("msg"),
        "request_id",
        F.when(ok, F.concat(F.lit("clip "), F.col("event_id"), F.lit(".wav"))).alias("file"),
        F.when(ok, F.col("size_bytes")).alias("size_bytes"),
        F.when(ok, fixed_decimals(F.col("duration_s"), 1)).alias("duration_s"),
        F.when(ok, ms(F.col("decode_s") + F.col("inference_s"))).alias("elapsed_ms"),
        F.when(ok, ms(F.col("decode_s"))).alias("decode_ms"),
        F.when(ok, ms(F.col("inference_s"))).alias("inference_ms"),
        F.when(ok, F.col("lang")).alias("lang"),
        F.when(~ok, F.col("status")).alias("status"),
        F.when(~ok, "POST").alias("method"),
        F.when(~ok, "/v1/audio/transcriptions").alias("path"),
        F.when(~ok, 'said "no"').alias("error"),
        F.md5("request_id").alias("trace_id"),
        F.substring(F.md5(F.concat("request_id", F.lit("transcribe"))), 1, 16).alias("span_id"),
    )


def log_lines(rows: DataFrame, format: str) -> DataFrame:
    """The same records as lines in a log format."""
    fields = log_fields(rows)
    if format == "json":
        stamped = fields.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        return stamped.select(F.to_json(F.struct(*stamped.columns)).alias("value"))
    parts = []
    for c in fields.columns:
        text = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if c == "time" else F.col(c).cast("string")
        quoted = F.when(text.rlike('[ "=]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '\\\\"'), F.lit('"'))).otherwise(text)
        parts.append(F.concat(F.lit(f"{c.upper() if format == 'journal' else c}="), quoted))
    return fields.select(F.concat_ws(" ", *parts).alias("value"))


def spans(rows: DataFrame) -> DataFrame:
    """Three spans per request: root, decoding, inference."""
    us = lambda c: F.round(c * 1_000_000).cast("bigint")
    at, decode, infer = F.unix_micros("arrival"), us(F.col("decode_s")), us(F.col("inference_s"))
    span = lambda name, start, stop: F.struct(F.lit(name).alias("name"), start.alias("start_us"), stop.alias("stop_us"))
    listed = F.array(span("transcribe", at, at + decode + infer + 1000), span("audio.decode", at, at + decode), span("model.inference", at + decode, at + decode + infer))
    long = rows.where("status <> 429").select("request_id", F.inline(listed))
    own = lambda name: F.substring(F.md5(F.concat(F.col("request_id"), name)), 1, 16)
    return long.select(
        F.md5("request_id").alias("trace_id"),
        own(F.col("name")).alias("span_id"),
        F.when(F.col("name") != "transcribe", own(F.lit("transcribe"))).alias("parent_id"),
        "name",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.timestamp_micros("stop_us").alias("end_ts"),
    )


def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model directory per supplier, in one of seven layouts."""
    layouts = """element_at(array(
        array('tokens.txt', 'encoder.int8.onnx', 'encoder.onnx', 'decoder.onnx', 'joiner.onnx'), array('tokens.txt', 'encoder.onnx', 'decoder.onnx'),
        array('tokens.txt', 'model.onnx'), array('tokens.txt', 'model.int8.onnx'), array('tokens.txt', 'model.onnx'), array('model.onnx'), array('tokens.txt', 'model.onnx')), int(s_suppkey % 7) + 1)"""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('model-', s_suppkey, case s_suppkey % 7 when 3 then '-sense_voice' when 4 then '-paraformer' else '' end)").alias("model_dir"), F.explode(F.expr(layouts)).alias("file"))
    return rows.select(
        "s_suppkey",
        "model_dir",
        "file",
        F.expr("bigint(case when file = 'tokens.txt' then if(s_suppkey % 7 = 6, 0, 1000 + s_suppkey) when s_suppkey % 13 = 0 then 100 else 1048576 + s_suppkey end)").alias("length"),
        F.expr("if(s_suppkey % 17 = 0, X'FF00', X'0807')").alias("head"),
        F.sha2(F.concat_ws("/", "model_dir", "file"), 256).alias("sha256"),
    )


def checksum_pins(inventory: DataFrame) -> DataFrame:
    """Pins for two directories in three, half of them with another checksum."""
    return inventory.where("s_suppkey % 3 < 2").select("model_dir", "file", F.expr("if(s_suppkey % 3 = 0, upper(sha256), sha2('other', 256))").alias("sha256"))
