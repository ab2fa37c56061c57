"""Readers and writers."""

from auricle.sources.scans import (
    scan_audio_corpus,
    scan_manifest,
    scan_model_inventory,
    scan_request_logs,
    scan_results,
    scan_spans,
    scan_vocab_lines,
    scan_vocab_pairs,
)
from auricle.sources.sinks import write_rejects, write_transcripts

__all__ = [
    "scan_audio_corpus",
    "scan_manifest",
    "scan_model_inventory",
    "scan_request_logs",
    "scan_results",
    "scan_spans",
    "scan_vocab_lines",
    "scan_vocab_pairs",
    "write_rejects",
    "write_transcripts",
]
