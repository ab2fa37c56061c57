"""Column functions for languages, ids, names and trace context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language codes that are reported as such.
LANGUAGES = (
    "bg", "hr", "cs", "da", "nl", "en", "et", "fi", "fr", "de", "el", "hu", "it",
    "lv", "lt", "mt", "pl", "pt", "ro", "ru", "sk", "sl", "es", "sv", "uk",
)
UNKNOWN = "unknown"
MODEL_NAME = "^[a-zA-Z0-9][a-zA-Z0-9._-]*$"
LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}


def filled(value: Column) -> Column:
    """Null for an empty string: empty means missing at table edges."""
    return F.nullif(value, F.lit(""))


def resolve_language(model_lang: Column, hint: Column) -> Column:
    """The model's language, else the client's hint, else ``unknown``."""
    return F.coalesce(filled(model_lang), filled(hint), F.lit(UNKNOWN))


def sanitize_lang(lang: Column) -> Column:
    """A known code or ``unknown``; everything else, null included, is ``other``."""
    return F.when(lang.isin(*LANGUAGES, UNKNOWN), lang).otherwise(F.lit("other"))


def clean_name(value: Column) -> Column:
    """Only ``[A-Za-z0-9._-]``, at most 128 characters; null if nothing is left."""
    return filled(F.substring(F.regexp_replace(value, "[^A-Za-z0-9._-]", ""), 1, 128))


def generated_id(key: Column) -> Column:
    """UUID-shaped id from a key's hash: the same on every run and retry."""
    h = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def request_id(header: Column, call_id: Column, key: Column) -> Column:
    """Header, else call id, cleaned; generated from ``key`` if nothing is left."""
    return F.coalesce(clean_name(F.coalesce(filled(header), filled(call_id))), generated_id(key))


def sanitize_filename(name: Column, key: Column) -> Column:
    return F.coalesce(clean_name(name), generated_id(key))


def trace_context(traceparent: Column) -> Column:
    """struct(trace_id, parent_id) of a W3C traceparent; null fields if malformed or all zero."""
    pattern = "^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    trace, parent = (filled(F.regexp_extract(traceparent, pattern, i)) for i in (1, 2))
    good = (trace != "0" * 32) & (parent != "0" * 16)
    return F.struct(F.when(good, trace).alias("trace_id"), F.when(good, parent).alias("parent_id"))


def valid_model_name(name: Column) -> Column:
    return F.coalesce(name.rlike(MODEL_NAME), F.lit(False))


def level_rank(level: Column) -> Column:
    """0 to 3; empty is info; null for an unknown level."""
    low = F.lower(level)
    rank = F.when(low == "", F.lit(LEVELS["info"]))
    for name, at in LEVELS.items():
        rank = rank.when(low == name, F.lit(at))
    return rank


def error_envelope(message: Column, kind: Column, code: Column) -> Column:
    """The JSON body of an error."""
    return F.to_json(F.struct(F.struct(message.alias("message"), kind.alias("type"), code.alias("code")).alias("error")))
