"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from auricle.operators import metrics
from auricle.plans.views import CLIP_FACTOR, CLIP_IDS, FACT_LANGUAGES, PADDED, STALLS

#: White space as Unicode counts it, for both ends of a token.
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TRIMMED = rf"regexp_replace(regexp_replace(token, '^{SPACE}', ''), '{SPACE}$', '')"

TOKENS = r"""
listed AS (
  SELECT doc_id AS clip_id, flatten(list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''),
    lambda w: list_transform(range(0, (length(w) - 1) // 4 + 1), lambda i: (CASE WHEN i = 0 THEN ' ' ELSE '' END) || substr(w, i * 4 + 1, 4)))) AS toks
  FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT clip_id, unnest(range(len(toks)))::INT AS pos, unnest(toks) AS token FROM listed),
timed AS (SELECT *, (pos * 0.08::DOUBLE)::FLOAT AS ts FROM tokens),
intervals AS (
  SELECT clip_id, pos, token, ts::DOUBLE AS ts, ts::DOUBLE AS start,
    coalesce(lead(ts) OVER (PARTITION BY clip_id ORDER BY pos)::DOUBLE, ts::DOUBLE + 0.1::DOUBLE) AS "end"
  FROM timed)"""

TIMING = f"""
kept AS (SELECT *, {TRIMMED} AS clean FROM intervals),
numbered AS (
  SELECT *, sum(CASE WHEN token[1] = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos) AS n FROM kept WHERE clean <> ''),
grouped AS (
  SELECT clip_id, n, string_agg(clean, '' ORDER BY pos) AS word, arg_min(start, pos) AS start, arg_max("end", pos) AS "end" FROM numbered GROUP BY clip_id, n),
words AS (
  SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY n) - 1)::INT AS word_id, word, start, "end" FROM grouped),
sentences AS (
  SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END)
    OVER (PARTITION BY clip_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
  FROM words),
parts AS (SELECT *, (row_number() OVER (PARTITION BY clip_id, sentence ORDER BY word_id) - 1) // 15 AS part FROM sentences),
cut AS (
  SELECT clip_id, sentence, part, arg_min(start, word_id) AS start, arg_max("end", word_id) AS "end", string_agg(word, ' ' ORDER BY word_id) AS text
  FROM parts GROUP BY clip_id, sentence, part),
segments AS (
  SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY sentence, part) - 1)::INT AS id, start, "end", text FROM cut)"""


def code(seconds: str, sign: str) -> str:
    ms = f"round({seconds} * 1000)::BIGINT"
    return f"printf('%02d:%02d:%02d{sign}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def block(sign: str) -> str:
    return f"""{code("start", sign)} || ' --> ' || {code('"end"', sign)} || chr(10) || text || chr(10) || chr(10)"""


SRT = f"""string_agg((id + 1)::VARCHAR || chr(10) || {block(",")}, '' ORDER BY id)"""
VTT = f"""'WEBVTT' || chr(10) || chr(10) || string_agg({block(".")}, '' ORDER BY id)"""

FRAMES = f"""
clipped AS (SELECT label::BIGINT * {CLIP_FACTOR} + vec_id // {CLIP_IDS} AS clip_id, vec_id, embedding FROM embeddings),
frames AS (
  SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY vec_id) - 1)::INT AS frame, embedding AS logits FROM clipped),
ids AS (SELECT clip_id, frame, (list_position(logits, list_max(logits)) - 1)::INT AS token_id FROM frames),
lagged AS (SELECT *, lag(token_id) OVER (PARTITION BY clip_id ORDER BY frame) AS previous FROM ids),
collapsed AS (
  SELECT clip_id, frame, token_id, (frame * 0.08::DOUBLE)::FLOAT AS ts FROM lagged WHERE (previous IS NULL OR previous <> token_id) AND token_id <> 63),
named AS (SELECT *, CASE WHEN token_id % 2 = 1 THEN 't' || token_id ELSE '▁t' || token_id END AS token FROM collapsed)"""

CTC_INTERVALS = """
intervals AS (
  SELECT clip_id, (row_number() OVER w - 1)::INT AS pos, replace(token, '▁', ' ') AS token, ts::DOUBLE AS ts, ts::DOUBLE AS start,
    coalesce(lead(ts) OVER w::DOUBLE, ts::DOUBLE + 0.1::DOUBLE) AS "end"
  FROM named WINDOW w AS (PARTITION BY clip_id ORDER BY frame))"""

_LANGS = "[" + ", ".join(f"'{x}'" for x in FACT_LANGUAGES) + "]"
_N = len(FACT_LANGUAGES)
_CODES = ", ".join(f"'{x}'" for x in FACT_LANGUAGES if x not in ("xx", ""))
FACTS = f"""
facts AS (
  SELECT event_id, 'req-' || event_id AS request_id, ts AS arrival, epoch_us(ts) AS arrival_us, (event_id % 5)::DOUBLE AS queue_s, value / 1000 AS decode_s, value / 100 AS inference_s,
    value AS duration_s, (event_id % 1000 + 1) * 1000 AS size_bytes, round(value * 16000)::BIGINT AS n_samples,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE ({_LANGS})[(user_id % {_N} + 1)::INT] END AS model_lang, ({_LANGS})[(event_id % {_N} + 1)::INT] AS hint,
    CASE WHEN event_type = 'error' OR value < 0.1 THEN 400 WHEN value > 300 THEN 413 WHEN event_id % 97 = 0 THEN 408 WHEN event_id % 89 = 0 THEN 429 ELSE 200 END AS status
  FROM events),
spoken AS (SELECT *, coalesce(nullif(model_lang, ''), nullif(hint, ''), 'unknown') AS raw_lang FROM facts),
labelled AS (SELECT *, CASE WHEN raw_lang IN ({", ".join(f"'{x}'" for x in FACT_LANGUAGES if x not in ("xx", ""))}) THEN raw_lang ELSE 'other' END AS clean_lang FROM spoken),
tagged AS (SELECT *, CASE WHEN status = 200 THEN clean_lang ELSE '' END AS lang FROM labelled)"""


def _micros(seconds: str) -> str:
    return f"round({seconds} * 1000000)::BIGINT"


GAUGES = f"""
busy AS (SELECT arrival_us + {_micros("queue_s")} AS start_us, arrival_us + {_micros("queue_s")} + {_micros("(decode_s + inference_s)")} AS stop_us FROM facts WHERE status <> 429),
waiting AS (SELECT arrival_us AS start_us, arrival_us + {_micros("queue_s")} AS stop_us FROM facts WHERE status <> 429 AND queue_s > 0),
busy_moves AS (SELECT at_us, sum(delta) AS delta FROM (SELECT start_us AS at_us, 1 AS delta FROM busy UNION ALL SELECT stop_us, -1 FROM busy) GROUP BY at_us),
waiting_moves AS (SELECT at_us, sum(delta) AS delta FROM (SELECT start_us AS at_us, 1 AS delta FROM waiting UNION ALL SELECT stop_us, -1 FROM waiting) GROUP BY at_us),
busy_level AS (SELECT at_us, (sum(delta) OVER (ORDER BY at_us))::BIGINT AS level FROM busy_moves),
waiting_level AS (SELECT at_us, (sum(delta) OVER (ORDER BY at_us))::BIGINT AS level FROM waiting_moves)"""

DAY = "86400000000"
OVERLOAD = f"""
counts AS (SELECT arrival_us // {DAY} * {DAY} AS window_start, count(*) AS requests, count_if(status = 429)::BIGINT AS rejected, count_if(status = 408)::BIGINT AS timed_out FROM facts GROUP BY 1),
busy_peak AS (SELECT at_us // {DAY} * {DAY} AS window_start, max(level) AS top, arg_max(level, at_us) AS last FROM busy_level GROUP BY 1),
waiting_peak AS (SELECT at_us // {DAY} * {DAY} AS window_start, max(level) AS top, arg_max(level, at_us) AS last FROM waiting_level GROUP BY 1),
seen AS (SELECT window_start FROM counts UNION SELECT window_start FROM busy_peak UNION SELECT window_start FROM waiting_peak),
every AS (SELECT unnest(range(min(window_start), max(window_start) + 1, {DAY})) AS window_start FROM seen),
peaks AS (
  SELECT window_start, coalesce(requests, 0) AS requests, coalesce(rejected, 0) AS rejected, coalesce(timed_out, 0) AS timed_out,
    coalesce(greatest(b.top, last_value(b.last IGNORE NULLS) OVER w), 0)::BIGINT AS peak_in_progress, coalesce(greatest(q.top, last_value(q.last IGNORE NULLS) OVER w), 0)::BIGINT AS peak_queued
  FROM every LEFT JOIN counts USING (window_start) LEFT JOIN busy_peak b USING (window_start) LEFT JOIN waiting_peak q USING (window_start)
  WINDOW w AS (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def histogram(value: str, where: str, buckets: tuple[float, ...], name: str) -> str:
    lines = [f"SELECT '{name}_bucket' AS name, '{b:g}' AS le, count_if(x <= {b!r}::DOUBLE)::DOUBLE AS value FROM v" for b in buckets]
    lines += [f"SELECT '{name}_bucket', '+Inf', count(*)::DOUBLE FROM v", f"SELECT '{name}_sum', NULL, round(coalesce(sum(x), 0), 4) FROM v", f"SELECT '{name}_count', NULL, count(*)::DOUBLE FROM v"]
    return f"v AS (SELECT {value} AS x FROM facts WHERE {where} AND {value} IS NOT NULL) " + " UNION ALL ".join(lines)


HISTOGRAMS = {
    "histogram_request": histogram("(decode_s + inference_s)", "status = 200", metrics.REQUEST_BUCKETS, "request_duration_seconds"),
    "histogram_decode": histogram("decode_s", "(status IN (200, 408, 413) OR (status = 400 AND n_samples BETWEEN 1 AND 1599))", metrics.DECODE_BUCKETS, "decode_duration_seconds"),
    "histogram_inference": histogram("inference_s", "status = 200", metrics.INFERENCE_BUCKETS, "inference_duration_seconds"),
    "histogram_audio": histogram("duration_s", "status = 200", metrics.AUDIO_BUCKETS, "audio_duration_seconds"),
}

LOGS = """
logged AS (
  SELECT arrival_us AS time, CASE WHEN status = 200 THEN 'INFO' WHEN status = 408 THEN 'WARN' ELSE 'ERROR' END AS level,
    CASE WHEN status = 200 THEN 'transcribed' ELSE 'request failed' END AS msg, request_id,
    CASE WHEN status = 200 THEN 'clip ' || event_id || '.wav' END AS file, CASE WHEN status = 200 THEN size_bytes END AS size_bytes,
    CASE WHEN status = 200 THEN printf('%.1f', duration_s) END AS duration_s,
    CASE WHEN status = 200 THEN floor((decode_s + inference_s) * 1000)::BIGINT END AS elapsed_ms,
    CASE WHEN status = 200 THEN floor(decode_s * 1000)::BIGINT END AS decode_ms, CASE WHEN status = 200 THEN floor(inference_s * 1000)::BIGINT END AS inference_ms,
    CASE WHEN status = 200 THEN lang END AS lang, CASE WHEN status <> 200 THEN status END AS status, CASE WHEN status <> 200 THEN 'POST' END AS method,
    CASE WHEN status <> 200 THEN '/v1/audio/transcriptions' END AS path, CASE WHEN status <> 200 THEN 'said "no"' END AS error,
    md5(request_id) AS trace_id, left(md5(request_id || 'transcribe'), 16) AS span_id
  FROM tagged WHERE status <> 429)"""


SPANS = f"""
timed_spans AS (SELECT request_id, arrival_us AS began, {_micros("decode_s")} AS d, {_micros("inference_s")} AS i FROM facts WHERE status <> 429),
span_rows AS (
  SELECT request_id, 'transcribe' AS name, began AS start_us, began + d + i + 1000 AS stop_us FROM timed_spans
  UNION ALL SELECT request_id, 'audio.decode', began, began + d FROM timed_spans UNION ALL SELECT request_id, 'model.inference', began + d, began + d + i FROM timed_spans),
spans AS (
  SELECT md5(request_id) AS trace_id, name, CASE WHEN name <> 'transcribe' THEN left(md5(request_id || 'transcribe'), 16) END AS parent_id, stop_us - start_us AS us, start_us, stop_us FROM span_rows)"""


def uuid_of(key: str) -> str:
    h = f"sha256({key})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def cleaned(value: str) -> str:
    return f"nullif(left(regexp_replace({value}, '[^A-Za-z0-9._-]', '', 'g'), 128), '')"


def feature_norm(deviation: str) -> str:
    return f"""
WITH {FRAMES},
bins AS (SELECT clip_id, frame, unnest(range(len(logits)))::INT AS bin, unnest(logits)::DOUBLE AS value FROM frames)
SELECT clip_id, frame, bin, round((value - avg(value) OVER w) / ({deviation}(value) OVER w + 1e-5::DOUBLE), 6) AS value FROM bins WINDOW w AS (PARTITION BY clip_id, bin)"""


MODELS = """
layouts AS (
  SELECT s_suppkey, 'model-' || s_suppkey || CASE s_suppkey % 7 WHEN 3 THEN '-sense_voice' WHEN 4 THEN '-paraformer' ELSE '' END AS model_dir,
    unnest(CASE s_suppkey % 7 WHEN 0 THEN ['tokens.txt', 'encoder.int8.onnx', 'encoder.onnx', 'decoder.onnx', 'joiner.onnx'] WHEN 1 THEN ['tokens.txt', 'encoder.onnx', 'decoder.onnx']
      WHEN 3 THEN ['tokens.txt', 'model.int8.onnx'] WHEN 5 THEN ['model.onnx'] ELSE ['tokens.txt', 'model.onnx'] END) AS file
  FROM supplier),
inventory AS (
  SELECT *, CASE WHEN file = 'tokens.txt' THEN CASE WHEN s_suppkey % 7 = 6 THEN 0 ELSE 1000 + s_suppkey END WHEN s_suppkey % 13 = 0 THEN 100 ELSE 1048576 + s_suppkey END AS length,
    s_suppkey % 17 <> 0 AS good FROM layouts)"""

BUCKETS = ", ".join(f"count_if(decode_s + inference_s <= {b!r}::DOUBLE)::BIGINT AS le_{str(b).replace('.', '_')}" for b in metrics.REQUEST_BUCKETS)
BUCKET_NAMES = ", ".join(f"le_{str(b).replace('.', '_')}" for b in metrics.REQUEST_BUCKETS)


def log_mel(n_mels: int, shift: int) -> str:
    """Frames (clip_id, frame, mel) by a relational transform: frames meet the rows of two matrices of cosines and sines, their powers those of the filters.

    ``shift`` is where the window of 400 samples begins in a frame of 512.
    """
    return f"""
h AS (SELECT doc_id AS clip_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
v AS (SELECT clip_id, h, unnest(range(length(h) // 4)) AS pos FROM h),
u AS (SELECT clip_id, pos, ('0x' || substr(h, pos * 4 + 3, 2) || substr(h, pos * 4 + 1, 2))::INT AS u FROM v),
wave AS (SELECT clip_id, count(*) AS n, list(((CASE WHEN u >= 32768 THEN u - 65536 ELSE u END)::FLOAT / 32767::FLOAT)::DOUBLE ORDER BY pos) AS x FROM u GROUP BY clip_id),
padded AS (SELECT clip_id, n, list_reverse(x[2:257]) || x || list_reverse(x[n - 256:n - 1]) AS x FROM wave WHERE n >= 400),
cut AS (SELECT clip_id, frame, x[frame * 160 + {shift + 1}:frame * 160 + {shift + 400}] AS x FROM (SELECT clip_id, x, unnest(range(1 + n // 160))::INT AS frame FROM padded)),
matrix AS (
  SELECT b, list((0.5 - 0.5 * cos(2 * pi() * k / 400)) * cos(2 * pi() * b * k / 512) ORDER BY k) AS re, list((0.5 - 0.5 * cos(2 * pi() * k / 400)) * sin(2 * pi() * b * k / 512) ORDER BY k) AS im
  FROM range(257) t(b), range(400) s(k) GROUP BY b),
power AS (SELECT clip_id, frame, list(pow(list_inner_product(x, re), 2) + pow(list_inner_product(x, im), 2) ORDER BY b) AS p FROM cut, matrix GROUP BY clip_id, frame),
edges AS (SELECT i, 700 * (pow(10, i * log10(1 + 8000 / 700::DOUBLE) / {n_mels + 1}) - 1) AS f FROM range({n_mels + 2}) t(i)),
bank AS (
  SELECT l.i AS m, list(greatest(least((b * 31.25 - l.f) / (c.f - l.f + 1e-10), (r.f - b * 31.25) / (r.f - c.f + 1e-10)), 0) / (r.f - l.f) ORDER BY b) AS w
  FROM edges l JOIN edges c ON c.i = l.i + 1 JOIN edges r ON r.i = l.i + 2, range(257) t(b) GROUP BY l.i),
mels AS (
  SELECT clip_id, frame, list(ln(greatest(list_inner_product(p, w), 1e-5))::FLOAT::DOUBLE ORDER BY m) AS mel FROM power, bank GROUP BY clip_id, frame
  UNION ALL SELECT h.clip_id, 0, list_transform(range({n_mels}), lambda i: 0::DOUBLE) FROM h LEFT JOIN wave USING (clip_id) WHERE coalesce(n, 0) < 400)"""


def log_mel_rows(n_mels: int, shift: int) -> str:
    return f"""WITH {log_mel(n_mels, shift)} SELECT clip_id, frame, array_to_string(list_transform(mel, lambda v: round(v * 1000)::BIGINT), ' ') AS mel_thousandths FROM mels"""


WINDOWED = f"windowed AS (SELECT arrival_us // 3600000000 * 3600000000 AS window_start, status, count(*) AS requests, {BUCKETS} FROM facts GROUP BY 1, 2)"

CLIPS = """
clips AS (
  SELECT doc_id AS clip_id, unhex((['52494646', '494433', '664C6143', '4F676753', '1A45DFA3', '0000000066747970', 'FFFB9000', 'FFF15080', '', '00'])[(doc_id % 10 + 1)::INT]) || encode(text) AS content
  FROM documents)"""
FORMATS = f"""{CLIPS},
bytes AS (
  SELECT clip_id, hex(content) AS h, octet_length(content) AS length, ('0x' || substr(hex(content) || '00', 1, 2))::INT AS b0,
    ('0x' || substr(hex(content) || '0000', 3, 2))::INT AS b1, ('0x' || substr(hex(content) || '000000', 5, 2))::INT AS b2 FROM clips),
labelled AS (
  SELECT clip_id, length, CASE WHEN h LIKE '52494646%' THEN 'wav' WHEN h LIKE '494433%' THEN 'mp3' WHEN h LIKE '664C6143%' THEN 'flac' WHEN h LIKE '4F676753%' THEN 'ogg'
    WHEN h LIKE '1A45DFA3%' THEN 'webm' WHEN substr(h, 9, 8) = '66747970' THEN 'm4a/mp4' WHEN length < 4 OR b0 <> 255 THEN NULL
    WHEN b1 & 224 = 224 AND (b1 >> 3) & 3 <> 1 AND (b1 >> 1) & 3 <> 0 AND b2 >> 4 <> 15 AND (b2 >> 2) & 3 <> 3 THEN 'mp3'
    WHEN b1 & 240 = 240 AND b2 >> 6 <> 3 THEN 'aac' END AS format
  FROM bytes)"""

def _le32(n: str) -> str:
    return f"unhex(printf('%02x%02x%02x%02x', {n} & 255, ({n} >> 8) & 255, ({n} >> 16) & 255, ({n} >> 24) & 255))"


def _format_chunk(channels: int, more: str = "") -> str:
    n = 16 + len(more) // 2
    return f"encode('fmt ') || unhex('{n:02x}0000000100{channels:02x}00803e0000{(32_000 * channels).to_bytes(4, 'little').hex()}{2 * channels:02x}001000{more}')"


_ODD = "encode('LIST') || unhex('05000000') || encode('notes') || unhex('00')"
_HEAD = f"encode('RIFF') || {_le32('(size + 36)')} || encode('WAVE')"
_DATA = f"encode('data') || {_le32('size')} || data"
WAVS = f"""
raw AS (SELECT doc_id AS clip_id, doc_id % 6 AS make, encode(text) AS data, octet_length(encode(text))::BIGINT AS size FROM documents),
wavs AS (
  SELECT clip_id, make, data, CASE WHEN make IN (0, 1, 2, 4) THEN size // 2 END AS n, CASE make
    WHEN 0 THEN {_HEAD} || {_format_chunk(1)} || {_DATA} WHEN 1 THEN {_HEAD} || {_ODD} || {_format_chunk(1)} || {_ODD} || {_DATA}
    WHEN 2 THEN {_HEAD} || {_format_chunk(1, "0000")} || {_DATA} WHEN 3 THEN {_HEAD} || {_format_chunk(2)} || {_DATA}
    WHEN 4 THEN {_HEAD} || {_format_chunk(1)} || encode('data') || {_le32('(size + 1000)')} || data ELSE encode('ID3') || data END AS content
  FROM raw)"""

OUTCOMES = """
o AS (
  SELECT *, CASE WHEN event_id % 109 = 0 THEN NULL ELSE n_samples * 2 END AS n, (CASE WHEN event_id % 109 = 0 THEN NULL ELSE n_samples * 2 END::FLOAT / 16000::FLOAT)::FLOAT AS duration FROM facts),
m AS (
  SELECT event_id, CASE
    WHEN size_bytes * 120 > 100 * 1048576 THEN [400::VARCHAR, 'file size exceeds maximum of 100 MB'] WHEN event_id % 101 = 0 THEN ['400', 'invalid request body']
    WHEN event_id % 103 = 0 THEN ['400', 'missing ''file'' field'] WHEN event_id % 107 = 0 THEN ['400', 'file too large or unreadable']
    WHEN event_id % 11 = 0 THEN ['400', 'audio decode failed: unsupported audio format'] WHEN n * 2 > 26214400 THEN ['400', 'audio decode failed: decoded audio exceeds maximum size']
    WHEN coalesce(n, 0) < 1 THEN ['400', 'audio decode failed: no audio'] WHEN n < 1600 THEN ['400', 'audio too short (minimum 100ms required)']
    WHEN duration > 600 THEN ['413', 'audio duration ' || printf('%.0f', duration::DOUBLE) || 's exceeds limit of 600s'] WHEN event_id % 97 = 0 THEN ['408', 'transcription timed out'] ELSE ['200', NULL] END AS r
  FROM o)"""

ORACLE_SQL = {
    "token_intervals": f'WITH {TOKENS} SELECT clip_id, pos, token, ts, start, "end" FROM intervals',
    "build_words": f'WITH {TOKENS}, {TIMING} SELECT clip_id, word_id, word, start, "end" FROM words',
    "build_segments": f'WITH {TOKENS}, {TIMING} SELECT clip_id, id, start, "end", text FROM segments',
    "build_segments_long": f'WITH {TOKENS}, {TIMING} SELECT clip_id, id, start, "end", text FROM segments',
    "render_srt": f"WITH {TOKENS}, {TIMING} SELECT clip_id, {SRT} AS srt FROM segments GROUP BY clip_id",
    "render_vtt": f"WITH {TOKENS}, {TIMING} SELECT clip_id, {VTT} AS vtt FROM segments GROUP BY clip_id",
    "render_verbose_json": f"""
WITH {TOKENS}, {TIMING},
w AS (SELECT clip_id, string_agg('{{"word":' || to_json(word) || ',"start":' || start || ',"end":' || "end" || '}}', ',' ORDER BY word_id) AS words FROM words GROUP BY clip_id),
s AS (SELECT clip_id, string_agg('{{"id":' || id || ',"start":' || start || ',"end":' || "end" || ',"text":' || to_json(text) || '}}', ',' ORDER BY id) AS segments FROM segments GROUP BY clip_id)
SELECT doc_id AS clip_id, '{{' || CASE WHEN n_chars IS NULL THEN '' ELSE '"duration":' || (n_chars::FLOAT / 16::FLOAT)::FLOAT || ',' END || CASE WHEN lang IS NULL THEN '' ELSE '"language":' || to_json(lang) || ',' END
  || coalesce('"segments":[' || segments || '],', '') || '"task":"transcribe"' || CASE WHEN text IS NULL THEN '' ELSE ',"text":' || to_json(text) END || coalesce(',"words":[' || words || ']', '') || '}}' AS body
FROM documents d LEFT JOIN w ON w.clip_id = d.doc_id LEFT JOIN s ON s.clip_id = d.doc_id""",
    "render_response": f"""
WITH {TOKENS}, {TIMING}, r AS (SELECT clip_id, {SRT} AS srt, {VTT} AS vtt FROM segments GROUP BY clip_id),
k AS (SELECT doc_id, (['json', 'text', 'srt', 'vtt', 'other'])[(doc_id % 5 + 1)::INT] AS response_format FROM documents)
SELECT doc_id AS clip_id, response_format, CASE response_format WHEN 'text' THEN 'document ' || doc_id WHEN 'srt' THEN coalesce(srt, '') WHEN 'vtt' THEN coalesce(vtt, 'WEBVTT' || chr(10) || chr(10)) ELSE '{{"text":"document ' || doc_id || '"}}' END AS body
FROM k LEFT JOIN r ON r.clip_id = k.doc_id""",
    "frame_argmax": f"WITH {FRAMES} SELECT clip_id, frame, token_id FROM ids",
    "ctc_collapse": f"WITH {FRAMES} SELECT clip_id, frame, token_id, ts::DOUBLE AS ts FROM collapsed",
    "ctc_text": f"""
WITH {FRAMES}, sizes AS (SELECT clip_id FROM frames GROUP BY clip_id)
SELECT s.clip_id, coalesce(trim(replace(string_agg(token, '' ORDER BY frame), '▁', ' ')), '') AS text, count(token)::INT AS n_tokens, arg_max(ts, frame)::DOUBLE AS last_ts,
  coalesce(string_agg(token, '|' ORDER BY frame), '') AS tokens, coalesce(string_agg((frame * 8)::VARCHAR, ',' ORDER BY frame), '') AS times, NULL::VARCHAR AS error
FROM sizes s LEFT JOIN named n USING (clip_id) GROUP BY s.clip_id""",
    "ctc_segments": f'WITH {FRAMES}, {CTC_INTERVALS}, {TIMING} SELECT clip_id, id, start, "end", text FROM segments',
    "detect_blank": "SELECT coalesce(min(p_partkey) FILTER (p_partkey % 977 = 976 OR p_name IN ('<blk>', '<blank>', '[blank]')), max(p_partkey))::INT AS blank_id FROM part",
    "token_lookup": """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_orderkey % 10 = 0 THEN 100000000 ELSE 0 END AS token_id FROM lineitem)
SELECT l_orderkey, l_linenumber, token_id::INT AS token_id, CASE WHEN p_partkey IS NULL THEN '<unk>' WHEN p_partkey % 977 = 976 THEN '<blank>' ELSE p_name END AS token FROM i LEFT JOIN part ON p_partkey = token_id""",
    "detokenize": f"""
WITH {TOKENS}, joined AS (SELECT clip_id, replace(string_agg(CASE WHEN token[1] = ' ' THEN '▁' || token[2:] ELSE token END, '' ORDER BY pos), '▁', ' ') AS token FROM tokens GROUP BY clip_id)
SELECT clip_id, {TRIMMED} AS text FROM joined""",
    "scan_vocab_pairs": "SELECT p_partkey::INT AS token_id, replace(p_name, ' ', '_') AS token FROM part WHERE p_partkey % 50 <> 0",
    "scan_manifest": """
SELECT 'clip/' || doc_id AS path, source || ' "quoted" é.wav' AS filename, CASE WHEN doc_id % 3 > 0 THEN lang END AS language, 'srt' AS response_format,
  NULL::VARCHAR AS request_id, NULL::VARCHAR AS litellm_call_id FROM documents""",
    "scan_results": f"""
WITH {TOKENS} SELECT clip_id, sha256(array_to_string(toks, '|')) AS tokens_sha256, sha256(array_to_string(list_transform(range(len(toks)), lambda i: i * 8), ',')) AS times_sha256, NULL::VARCHAR AS language FROM listed""",
    "scan_spans": f"WITH {FACTS}, {SPANS} SELECT trace_id, parent_id, name, start_us, stop_us AS end_us FROM spans",
    "sniff_format": f"WITH {FORMATS} SELECT clip_id, format, length::BIGINT AS length FROM labelled",
    "format_profile": f"WITH {FORMATS} SELECT coalesce(format, 'unknown') AS format, format IS NOT NULL AS accepted, count(*) AS clips, sum(length)::BIGINT AS bytes FROM labelled GROUP BY 1, 2",
    "intake_outcome": f"""
WITH {FACTS}, {OUTCOMES} SELECT event_id, r[1]::INT AS code, CASE WHEN r[1] <> '200' THEN 'invalid_request_error' END AS type, r[2] AS message,
  CASE WHEN r[1] <> '200' THEN '{{"error":{{"message":"' || r[2] || '","type":"invalid_request_error","code":' || r[1] || '}}}}' END AS body FROM m""",
    "payload_outcome": """
WITH x AS (SELECT vec_id, CASE vec_id % 50 WHEN 0 THEN [] WHEN 1 THEN ['nan'::FLOAT] || embedding ELSE embedding END AS samples, CASE WHEN vec_id % 50 = 3 THEN 0 ELSE 16000 END AS rate, CASE WHEN vec_id % 50 = 2 THEN 1 ELSE 0 END AS extra FROM embeddings),
p AS (SELECT *, len(samples) * 4 + extra AS length FROM x)
SELECT vec_id AS clip_id, CASE WHEN length % 4 <> 0 THEN 'samples must be float32 aligned (multiple of 4 bytes)' WHEN length = 0 THEN 'empty audio' WHEN rate <= 0 THEN 'sample_rate must be positive'
  WHEN length // 4 > 9600000 THEN 'audio exceeds maximum of 600 seconds' WHEN len(list_filter(samples, lambda v: NOT isfinite(v))) > 0 THEN 'audio contains non-finite values' END AS error,
  len(samples)::INT AS n_samples FROM p""",
    "language_labels": f"WITH {FACTS} SELECT event_id, raw_lang, clean_lang AS lang FROM labelled",
    "request_ids": f"""
WITH r AS (SELECT doc_id, source, 'path/' || doc_id AS key, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN 'call ' || doc_id ELSE '' END, '')) AS named,
  CASE WHEN doc_id % 7 = 0 THEN '???' ELSE 'clip (' || doc_id || ').wav' END AS name FROM documents)
SELECT doc_id, coalesce({cleaned("named")}, {uuid_of("key")}) AS request_id, coalesce({cleaned("name")}, {uuid_of("key")}) AS file,
  coalesce(regexp_full_match(CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-' END || source, '[a-zA-Z0-9][a-zA-Z0-9._-]*'), false) AS valid_name FROM r""",
    "trace_context": f"""
WITH {FACTS}, t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN '00-' || repeat('0', 32) || '-' || left(md5(request_id), 16) || '-01' ELSE '00-' || md5(request_id) || '-' || left(md5(event_id::VARCHAR), 16) || '-01' END AS parent FROM facts),
e AS (SELECT event_id, regexp_extract(parent, '^[0-9a-f]{{2}}-([0-9a-f]{{32}})-([0-9a-f]{{16}})-[0-9a-f]{{2}}$', ['trace', 'span']) AS g FROM t)
SELECT event_id, CASE WHEN g.trace <> '' AND g.trace <> repeat('0', 32) AND g.span <> repeat('0', 16) THEN g.trace END AS trace_id,
  CASE WHEN g.trace <> '' AND g.trace <> repeat('0', 32) AND g.span <> repeat('0', 16) THEN g.span END AS parent_id FROM e""",
    "requests_total": f"WITH {FACTS} SELECT status, lang, count(*) AS value FROM tagged GROUP BY status, lang",
    "audio_bytes_total": f"WITH {FACTS} SELECT coalesce(sum(size_bytes), 0)::BIGINT AS value FROM facts WHERE status = 200",
    **{name: f"WITH {FACTS}, {sql}" for name, sql in HISTOGRAMS.items()},
    "in_progress_over_time": f"WITH {FACTS}, {GAUGES} SELECT at_us, level FROM busy_level",
    "queued_over_time": f"WITH {FACTS}, {GAUGES} SELECT at_us, level FROM waiting_level",
    "overload_report": f"WITH {FACTS}, {GAUGES}, {OVERLOAD} SELECT *, peak_in_progress > 4 OR peak_queued > 8 AS over_limit FROM peaks",
    "union_metrics": f"""
WITH {FACTS}, {GAUGES}, {", ".join(f"h{i} AS (WITH {h})" for i, h in enumerate(HISTOGRAMS.values()))}
SELECT 'requests_total' AS name, '{{"status":"' || status || '","lang":"' || lang || '"}}' AS labels, NULL AS le, count(*)::DOUBLE AS value FROM tagged GROUP BY status, lang
UNION ALL SELECT 'audio_bytes_total', NULL, NULL, coalesce(sum(size_bytes), 0)::DOUBLE FROM facts WHERE status = 200
{" ".join(f"UNION ALL SELECT name, NULL, le, value FROM h{i}" for i in range(len(HISTOGRAMS)))}
UNION ALL SELECT 'requests_in_progress', NULL, NULL, arg_max(level, at_us)::DOUBLE FROM busy_level
UNION ALL SELECT 'requests_queued', NULL, NULL, arg_max(level, at_us)::DOUBLE FROM waiting_level
UNION ALL SELECT 'model_info', '{{"name":"models","provider":"cpu","threads":"4"}}', NULL, 1
UNION ALL SELECT 'build_info', '{{"version":"dev","commit":"none","build_time":"unknown"}}', NULL, 1""",
    **{f"log_records_{f}": f"WITH {FACTS}, {LOGS} SELECT * FROM logged" for f in ("json", "text", "journal")},
    "log_warnings": f"WITH {FACTS}, {LOGS} SELECT request_id, level, status, NULL::VARCHAR AS lang FROM logged WHERE level <> 'INFO'",
    "log_span_breakdown": f"""
WITH {FACTS}, {SPANS}, g AS (
  SELECT trace_id, max(us) FILTER (name = 'transcribe') AS total_us, coalesce(sum(us) FILTER (name = 'audio.decode'), 0)::BIGINT AS decode_us,
    coalesce(sum(us) FILTER (name = 'model.inference'), 0)::BIGINT AS inference_us FROM spans GROUP BY trace_id)
SELECT *, total_us - decode_us - inference_us AS other_us FROM g""",
    "logs_with_spans": f"""
WITH {FACTS}, {LOGS}, {SPANS} SELECT l.request_id, l.trace_id, s.us AS root_us FROM logged l LEFT JOIN spans s ON s.trace_id = l.trace_id AND s.parent_id IS NULL""",
    "feature_norm_torch": feature_norm("stddev_samp"),
    "feature_norm_tdt": feature_norm("stddev_pop"),
    "pad_frames": f"""
WITH {FRAMES}, n AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY clip_id), g AS (SELECT clip_id, n, unnest(range({PADDED}))::INT AS frame FROM n)
SELECT clip_id, frame, bin, coalesce(logits[bin + 1], 0)::DOUBLE AS value, least(n, {PADDED})::INT AS n_valid, n > {PADDED} AS truncated FROM g LEFT JOIN frames USING (clip_id, frame), (SELECT unnest(range(64))::INT AS bin)""",
    "frame_counts": "SELECT doc_id AS clip_id, (CASE WHEN strlen(text) // 2 < 400 THEN 1 ELSE 1 + strlen(text) // 2 // 160 END)::INT AS frames FROM documents WHERE text IS NOT NULL",
    "log_mel_80": log_mel_rows(80, 56),
    "log_mel_128": log_mel_rows(128, 0),
    "mel_means": f"""
WITH {log_mel(80, 56)}, bins AS (SELECT unnest(range(80))::INT AS bin, unnest(mel) AS value FROM mels)
SELECT bin, round(avg(value), 3) AS mean, count(*) AS frames FROM bins GROUP BY bin""",
    "echo_transcribe": """
SELECT vec_id AS clip_id, CASE WHEN vec_id % 50 = 0 THEN '' ELSE '[echo] ' || len(embedding) || ' samples at 16000Hz, ' || printf('%.1f', len(embedding) / 16000) || 's' END AS text,
  CASE WHEN vec_id % 50 = 0 THEN '' ELSE 'en' END AS language, (CASE WHEN vec_id % 50 = 0 THEN 0 ELSE len(embedding) / 16000 END)::FLOAT::DOUBLE AS duration, 0::INT AS n_tokens, NULL::VARCHAR AS error FROM embeddings""",
    "echo_columns": """
SELECT vec_id AS clip_id, CASE WHEN vec_id % 50 = 0 THEN '' ELSE '[echo] ' || len(embedding) || ' samples at 16000Hz, ' || printf('%.1f', len(embedding) / 16000) || 's' END AS text,
  CASE WHEN vec_id % 50 = 0 THEN '' ELSE 'en' END AS language, (CASE WHEN vec_id % 50 = 0 THEN 0 ELSE len(embedding) / 16000 END)::FLOAT::DOUBLE AS duration FROM embeddings""",
    "model_type_of": f"""
WITH {MODELS}, h AS (
  SELECT model_dir, bool_or(file = 'tokens.txt') AS tokens, {", ".join(f"bool_or(file IN ('{x}.onnx', '{x}.int8.onnx')) AS {x}" for x in ("encoder", "decoder", "joiner", "model"))},
    min(file) FILTER (file = 'encoder.int8.onnx') AS small_encoder, min(file) FILTER (file = 'encoder.onnx') AS full_encoder,
    min(file) FILTER (file = 'model.int8.onnx') AS small_model, min(file) FILTER (file = 'model.onnx') AS full_model FROM inventory GROUP BY model_dir)
SELECT model_dir, CASE WHEN NOT tokens THEN NULL WHEN encoder AND decoder AND joiner THEN 'nemo_transducer' WHEN encoder AND decoder THEN 'whisper'
  WHEN model AND regexp_matches(model_dir, 'sense_voice|sensevoice|SenseVoice') THEN 'sense_voice' WHEN model AND regexp_matches(model_dir, 'paraformer|Paraformer') THEN 'paraformer'
  WHEN model THEN 'nemo_ctc' END AS model_type, coalesce(small_encoder, full_encoder) AS encoder, coalesce(small_model, full_model) AS model FROM h""",
    "model_integrity": f"""
WITH {MODELS}, r AS (
  SELECT model_dir, CASE WHEN max(length) FILTER (file = 'tokens.txt') IS NULL THEN 'tokens.txt not found' WHEN max(length) FILTER (file = 'tokens.txt') = 0 THEN 'tokens.txt is empty'
    WHEN min(file) FILTER (file LIKE '%.onnx' AND length < 1048576) IS NOT NULL THEN 'file is suspiciously small: ' || min(file) FILTER (file LIKE '%.onnx' AND length < 1048576)
    WHEN min(file) FILTER (file LIKE '%.onnx' AND NOT good) IS NOT NULL THEN 'file has an invalid header: ' || min(file) FILTER (file LIKE '%.onnx' AND NOT good)
    WHEN count(*) FILTER (file LIKE '%.onnx') = 0 THEN 'no ONNX model files found' END AS reason
  FROM inventory GROUP BY model_dir)
SELECT model_dir, reason IS NULL AS ok, reason FROM r""",
    "checksum_status": f"""
WITH {MODELS}, sums AS (SELECT s_suppkey, model_dir, file, sha256(model_dir || '/' || file) AS sum FROM inventory),
pins AS (SELECT model_dir, file, CASE WHEN s_suppkey % 3 = 0 THEN upper(sum) ELSE sha256('other') END AS pin FROM sums WHERE s_suppkey % 3 < 2)
SELECT model_dir, file, CASE WHEN pin IS NULL THEN 'unpinned' WHEN lower(pin) = lower(sum) THEN 'match' ELSE 'mismatch' END AS status FROM sums LEFT JOIN pins USING (model_dir, file)""",
    "artifact_checksum": f"WITH {CLIPS} SELECT 'documents' AS model_dir, clip_id::VARCHAR AS file, sha256(content) AS sha256 FROM clips",
    "pcm16_to_float": """
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, h, unnest(range(length(h) // 4))::INT AS pos FROM h),
v AS (SELECT doc_id, pos, ('0x' || substr(h, pos * 4 + 3, 2) || substr(h, pos * 4 + 1, 2))::INT AS u FROM s)
SELECT doc_id AS clip_id, pos, ((CASE WHEN u >= 32768 THEN u - 65536 ELSE u END)::FLOAT / 32767::FLOAT)::DOUBLE AS value FROM v""",
    "pending_clips": """
WITH corpus AS (SELECT 'clip/' || doc_id AS path, n_chars AS version, doc_id FROM documents),
done AS (SELECT path, version - CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS version FROM corpus WHERE doc_id % 2 = 0)
SELECT path, doc_id FROM corpus ANTI JOIN done USING (path, version)""",
    "attach_manifest": """
WITH m AS (SELECT 'clip/' || (doc_id + CASE WHEN quality = 0 THEN 1000000000 ELSE 0 END) AS path FROM labels), c AS (SELECT 'clip/' || doc_id AS path, n_chars, true AS there FROM documents)
SELECT path, n_chars, coalesce(there, false) AS has_file FROM m LEFT JOIN c USING (path)""",
    "write_pending": f"""
SELECT 'clip/' || doc_id AS path, CASE WHEN lang IN ({_CODES}) THEN lang ELSE 'other' END AS lang, sha256(text) AS text_sha256, (doc_id % 2)::INT AS batch FROM documents""",
    "stream_requests_total": f"WITH {FACTS} SELECT status, lang, count(*) AS value FROM tagged GROUP BY status, lang",
    "stream_windowed": f"""
WITH {FACTS}, {WINDOWED} SELECT window_start, status, requests, {BUCKET_NAMES} FROM windowed
WHERE window_start + 3600000000 <= (SELECT max(arrival_us) // 1000 * 1000 - 600000000 FROM facts)""",
    "windowed_counts": f"WITH {FACTS}, {WINDOWED} SELECT window_start, status, requests, {BUCKET_NAMES} FROM windowed",
    "timeouts": f"""
WITH {FACTS} SELECT request_id, arrival_us AS started_us FROM facts WHERE NOT (status = 200 AND {_micros("(duration_s * 3)")} BETWEEN 0 AND 300000000)""",
    "stream_timeouts": f"""
WITH {FACTS}, ended AS (SELECT *, arrival_us + {_micros("(duration_s * 3)")} AS ended_us FROM facts),
mark AS (SELECT least(max(arrival_us) // 1000 * 1000, (max(ended_us) FILTER (status = 200)) // 1000 * 1000) - 600000000 AS mark FROM ended)
SELECT request_id, arrival_us AS started_us FROM ended, mark
WHERE NOT (status = 200 AND ended_us BETWEEN arrival_us AND arrival_us + 300000000) AND arrival_us + 300000000 <= mark""",
    "stream_intake": f"""
WITH {WAVS}, m AS (
  SELECT *, CASE WHEN coalesce(n, 0) < 1 THEN 'audio decode failed: no audio' WHEN n < 1600 THEN 'audio too short (minimum 100ms required)' END AS message FROM wavs)
SELECT clip_id, CASE WHEN make = 5 THEN 'mp3' ELSE 'wav' END AS format, n AS n_samples, CASE WHEN message IS NULL THEN 200 ELSE 400 END AS code, message,
  CASE WHEN message IS NULL THEN sha256(content) END AS content_sha256 FROM m""",
    "transcribe_outcomes": f"""
WITH {WAVS}, m AS (
  SELECT clip_id, n, CASE WHEN coalesce(n, 0) < 1 THEN 'audio decode failed: no audio' WHEN n < 1600 THEN 'audio too short (minimum 100ms required)' END AS rejected,
    CASE n % {STALLS} WHEN 0 THEN 'TimeoutError: no answer within 3 s' WHEN 1 THEN 'ValueError: not in the mood' END AS failed FROM wavs)
SELECT clip_id, CASE WHEN rejected IS NULL AND failed IS NULL THEN '[echo] ' || n || ' samples at 16000Hz, ' || printf('%.1f', n / 16000) || 's' ELSE '' END AS text,
  CASE WHEN rejected IS NULL THEN failed END AS error, CASE WHEN rejected IS NOT NULL THEN 400 WHEN failed IS NOT NULL THEN 408 ELSE 200 END AS code,
  coalesce(rejected, CASE WHEN failed IS NOT NULL THEN 'transcription timed out' END) AS message FROM m""",
    "wav_corpus": f"""
WITH {WAVS}, h AS (SELECT clip_id, hex(data) AS h, n FROM wavs WHERE n IS NOT NULL),
s AS (SELECT clip_id, h, unnest(range(n)) AS pos FROM h),
v AS (SELECT clip_id, pos, ('0x' || substr(h, pos * 4 + 3, 2) || substr(h, pos * 4 + 1, 2))::INT AS u FROM s),
t AS (SELECT clip_id, sum(CASE WHEN u >= 32768 THEN u - 65536 ELSE u END)::BIGINT AS total, sum((CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) * (pos % 1000 + 1))::BIGINT AS weighted FROM v GROUP BY clip_id)
SELECT 'clip/' || clip_id AS path, n IS NULL AS needs_transcode, n AS n_samples, CASE WHEN n IS NOT NULL THEN coalesce(total, 0) END AS total, CASE WHEN n IS NOT NULL THEN coalesce(weighted, 0) END AS weighted
FROM wavs LEFT JOIN t USING (clip_id)""",
    "stream_dedupe": f"""
WITH RECURSIVE {FACTS}, keyed AS (SELECT 'user-' || (event_id // 3) AS request_id, arrival_us AS time, event_id, status, duration_s, model_lang FROM facts WHERE arrival_us IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY time, event_id::VARCHAR NULLS FIRST, status::VARCHAR NULLS FIRST, duration_s::VARCHAR NULLS FIRST, model_lang NULLS FIRST) AS n FROM keyed),
pointed AS (SELECT *, min(n) OVER (PARTITION BY request_id ORDER BY time RANGE BETWEEN {DAY} + 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM ranked),
kept AS (SELECT * FROM pointed WHERE n = 1 UNION ALL SELECT p.* FROM kept k JOIN pointed p ON p.request_id IS NOT DISTINCT FROM k.request_id AND p.n = k.following)
SELECT request_id, time, event_id, status, duration_s, model_lang FROM kept WHERE time + {DAY} <= (SELECT max(time) // 1000 * 1000 - {DAY} FROM keyed)""",
}
