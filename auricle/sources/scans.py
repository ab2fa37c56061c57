"""Readers: audio, manifests, results, vocabularies, logs, spans, model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle import schemas
from auricle.sources.artifacts import ArtifactSource

# White space that parts fields, and control characters taken out of tokens.
WHITE = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"
LINE_FIELD = r'([A-Za-z_][A-Za-z0-9_.-]*)=("(?:[^"\\]|\\.)*"|[^ "]*)'


def scan_audio_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Clips under ``path`` with their size. Filters on length and time reach the source, and content is read only if selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def scan_manifest(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).format(format).load(path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).parquet(path)


def scan_spans(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.schema(schemas.SPANS).format(format).load(path)


def scan_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary with id = line number (from 0); the first field of each line by white space of any kind, control characters then removed.

    Blank lines keep their id with an empty token. One file is one row, as a vocabulary is small.
    """
    text = F.regexp_replace("value", "\r\n?", "\n")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("token_id", "line"))
    return lines.select("token_id", F.regexp_replace(F.get(fields("line"), F.lit(0)), CONTROL, "").alias("token"))


def fields(line: str) -> F.Column:
    """Fields of a line by white space of any kind."""
    return F.split(F.regexp_replace(line, f"^{WHITE}+", ""), f"{WHITE}+")


def scan_vocab_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary of ``token id`` lines; lines with under two fields are skipped."""
    trimmed = spark.read.text(path).select(F.regexp_replace("value", f"{WHITE}+$", "").alias("value"))
    rows = trimmed.select(fields("value").alias("f")).where(F.size("f") >= 2)
    return rows.select(F.get("f", F.lit(1)).try_cast("int").alias("token_id"), F.get("f", F.lit(0)).alias("token")).where("token_id is not null")


def typed_record(fields: F.Column) -> F.Column:
    """A log record from a map of strings, keys in lower case."""
    columns = []
    for part in schemas.LOG_RECORDS.split(", "):
        name, kind = part.split(" ")
        columns.append(fields[name].try_cast(kind).alias(name))
    return F.struct(*columns)


def parse_request_logs(lines: DataFrame, format: str) -> DataFrame:
    """Lines (column ``value``) of one of the formats json, text or journal as typed log records.

    A malformed line gives a record of nulls. Journal lines hold upper-case keys.
    """
    if format == "json":
        return lines.select(F.from_json("value", schemas.LOG_RECORDS, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    if format not in ("text", "journal"):
        raise ValueError(f"log lines can be read as json, text or journal, not as {format!r}")
    keys = F.transform(F.regexp_extract_all("value", F.lit(LINE_FIELD), F.lit(1)), F.lower)
    raw = F.regexp_extract_all("value", F.lit(LINE_FIELD), F.lit(2))
    values = F.transform(raw, lambda v: F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return lines.select(typed_record(F.map_from_entries(first)).alias("r")).select("r.*")


def scan_request_logs(spark: SparkSession, path: str, format: str) -> DataFrame:
    return parse_request_logs(spark.read.text(path), format)


def scan_model_inventory(spark: SparkSession, root: str, checksums: bool = False, heads: bool = True) -> DataFrame:
    """Files of model directories: directory, name, length, first two bytes, and SHA-256 if asked for.

    Files may be larger than 2 GB: two bytes of each are read, or with ``checksums`` all of it, a range at a time; without either, lengths are listed alone.
    """
    spark.dataSource.register(ArtifactSource)
    return spark.read.format(ArtifactSource.name()).option("heads", str(heads)).option("checksums", str(checksums)).load(root)
