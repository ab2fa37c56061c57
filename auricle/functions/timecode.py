"""Subtitle time codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _code(seconds: Column, sign: str) -> Column:
    ms = F.round(seconds * 1000).cast("bigint")
    whole = F.floor(ms / 1000)
    return F.format_string(f"%02d:%02d:%02d{sign}%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms % 1000)


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``; hours take more digits when needed."""
    return _code(seconds, ",")


def vtt_time(seconds: Column) -> Column:
    return _code(seconds, ".")
