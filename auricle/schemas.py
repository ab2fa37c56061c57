"""Table schemas and job limits."""

from __future__ import annotations

from dataclasses import dataclass

CLIPS = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = "path string, filename string, language string, response_format string, request_id string, litellm_call_id string"
SAMPLES = "clip_id bigint, sample_rate int, samples array<float>"
FRAMES = "clip_id bigint, frame int, logits array<float>"
FEATURES = "clip_id bigint, frame int, mel array<float>"
VOCABULARY = "token_id int, token string"
RESULT = "text string, language string, duration float, inference_ms bigint, tokens array<string>, timestamps array<float>"
RESULTS = f"clip_id bigint, {RESULT}"
TOKENS = "clip_id bigint, pos int, token string, ts float"
WORDS = "clip_id bigint, word_id int, word string, start double, `end` double"
SEGMENTS = "clip_id bigint, id int, start double, `end` double, text string"
REQUEST_FACTS = (
    "request_id string, arrival timestamp, queue_s double, decode_s double, inference_s double, duration_s double, "
    "size_bytes bigint, n_samples bigint, model_lang string, hint string, status int"
)
LOG_RECORDS = (
    "time timestamp, level string, msg string, request_id string, file string, size_bytes bigint, duration_s string, elapsed_ms bigint, "
    "decode_ms bigint, inference_ms bigint, lang string, status int, method string, path string, error string, trace_id string, span_id string"
)
SPANS = "trace_id string, span_id string, parent_id string, name string, start_ts timestamp, end_ts timestamp"
MODEL_INVENTORY = "model_dir string, file string, length bigint, head binary, sha256 string"
CHECKSUM_PINS = "model_dir string, file string, sha256 string"


@dataclass(frozen=True)
class Limits:
    """Limits of the intake gate and of the service whose facts are analysed."""

    max_concurrent: int = 4
    max_queue: int = 8
    max_file_size_mb: int = 100
    max_audio_s: int = 600
    request_timeout_s: int = 300
    num_threads: int = 4
    port: int = 8000
    provider: str = "cpu"
    model_dir: str = "models"

    def __post_init__(self) -> None:
        for name in ("max_concurrent", "max_file_size_mb", "max_audio_s", "request_timeout_s"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be > 0, got {getattr(self, name)}")
        if self.max_queue < 0:
            raise ValueError(f"max_queue must be >= 0, got {self.max_queue}")
        if not 0 < self.port <= 65535:
            raise ValueError(f"port must be 1-65535, got {self.port}")
