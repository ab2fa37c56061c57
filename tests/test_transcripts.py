"""Golden values, sequential restatements and edge cases of the transcript operators."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auricle import schemas
from auricle.functions import audio, labels, timecode
from auricle.operators import decode, engines, features, intake, logs, metrics, models, render, timing
from auricle.schemas import Limits
from auricle.sources import scans, write_rejects, write_transcripts
from auricle.streaming import jobs


def tokens_of(spark, rows):
    return spark.createDataFrame(rows, schemas.TOKENS)


def words_of(spark, tokens, stamps=None):
    stamps = stamps or [0.08 * i for i in range(len(tokens))]
    df = tokens_of(spark, [(1, i, t, s) for i, (t, s) in enumerate(zip(tokens, stamps, strict=True))])
    return [(r.word, r.start, r.end) for r in timing.build_words(timing.token_intervals(df)).orderBy("word_id").collect()]


def test_words(spark):
    assert [w for w, _, _ in words_of(spark, [" Hello", " world", " today"])] == ["Hello", "world", "today"]
    got = words_of(spark, [" Al", "les", " hat", " ein", " En", "de", "."], [0.0, 0.1, 0.2, 0.4, 0.8, 0.9, 0.95])
    assert [w for w, _, _ in got] == ["Alles", "hat", "ein", "Ende."]
    assert got[0][1:] == (0.0, pytest.approx(0.2, abs=1e-6))
    assert got[3][1:] == (pytest.approx(0.8, abs=1e-6), pytest.approx(1.05, abs=1e-6))
    assert [w for w, _, _ in words_of(spark, [" Hello", " ", " world", "\t", "!"])] == ["Hello", "world!"]
    assert timing.build_segments(timing.build_words(timing.token_intervals(tokens_of(spark, [])))).count() == 0


def test_segments(spark):
    words = spark.createDataFrame([(1, i, w, i * 0.5, i * 0.5 + 0.5) for i, w in enumerate("Hello world. How are you?".split())], schemas.WORDS)
    got = timing.build_segments(words).orderBy("id").collect()
    assert [(r.id, r.start, r.end, r.text) for r in got] == [(0, 0.0, 1.0, "Hello world."), (1, 1.0, 2.5, "How are you?")]
    words = spark.createDataFrame([(1, i, "word", float(i), i + 1.0) for i in range(20)], schemas.WORDS)
    assert [len(r.text.split()) for r in timing.build_segments(words).orderBy("id").collect()] == [15, 5]


def sequential_words(tokens):
    words, current = [], ""
    for t in tokens:
        clean = t.strip()
        if clean:
            if t.startswith(" ") and current:
                words.append(current)
                current = ""
            current += clean
    return words + [current] * bool(current)


def sequential_segments(words):
    out, current = [], []
    for w in words:
        current.append(w)
        if w[-1] in ".!?" or len(current) >= 15:
            out.append(" ".join(current))
            current = []
    return out + [" ".join(current)] * bool(current)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([" a", "b", ".", " ", "\t", " c!", "?", " d", "　", " e　"]), max_size=60), min_size=1, max_size=6))
def test_timing_is_sequential(spark, clips):
    rows = [(c, i, t, 0.08 * i) for c, tokens in enumerate(clips) for i, t in enumerate(tokens)]
    words = timing.build_words(timing.token_intervals(tokens_of(spark, rows)))
    segments = timing.build_segments(words)
    by = {c: [] for c in range(len(clips))}
    for r in words.orderBy("clip_id", "word_id").collect():
        by[r.clip_id].append(r.word)
    assert list(by.values()) == [sequential_words(t) for t in clips]
    cut = {c: [] for c in range(len(clips))}
    for r in segments.orderBy("clip_id", "id").collect():
        cut[r.clip_id].append(r.text)
    assert list(cut.values()) == [sequential_segments(sequential_words(t)) for t in clips]


def test_one_exchange(spark, data_dir):
    from auricle.plans import views

    words = timing.build_words(timing.token_intervals(views.tokens(spark, data_dir)))
    plan = timing.build_segments(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def plain(rows):
    return None if rows is None else [tuple(r) for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from([" a", "b", ".", " ", "\t", " c!", "?", "▁d", "　", " e　", None, "\x1c"]), max_size=60), st.integers(-3, 3)), min_size=1, max_size=6), st.booleans())
def test_row_timing_is_the_long_form(spark, clips, strict):
    """Words and segments row by row are those of the long form, whatever the lengths of both arrays."""
    rows = [(c, "", "", 0.0, 0, tokens, [0.08 * i for i in range(max(0, len(tokens) + more))]) for c, (tokens, more) in enumerate(clips)]
    results = spark.createDataFrame([*rows, (99, "", "", 0.0, 0, None, None)], schemas.RESULTS)
    intervals = timing.token_intervals(timing.explode_tokens(results, strict))
    words = timing.build_words(intervals)
    got = timing.with_timing(results, strict)
    assert sorted(map(tuple, timing.words_of(got).collect())) == sorted(map(tuple, words.collect()))
    assert sorted(map(tuple, timing.segments_of(got).collect())) == sorted(map(tuple, timing.build_segments(words).collect()))
    assert sorted(map(tuple, timing.timed_tokens(results, strict).select("clip_id", "pos", "token", "start", "end").collect())) == sorted(map(tuple, intervals.select("clip_id", "pos", "token", "start", "end").collect()))
    nested = timing.nest_timing(results.select("clip_id"), words, timing.build_segments(words))
    assert sorted((r.clip_id, plain(r.words), plain(r.segments)) for r in got.collect()) == sorted((r.clip_id, plain(r.words), plain(r.segments)) for r in nested.collect())


@pytest.mark.parametrize("name", ["token_intervals", "build_words", "build_segments", "render_srt", "render_vtt"])
def test_no_exchange(spark, data_dir, name):
    from auricle.plans import queries

    assert "Exchange" not in queries.QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString()


def test_verbose_json(spark):
    import json

    tokens, stamps = [" Hello", " wor", "ld.", " Bye"], [0.0, 0.32, 0.4, 1.0]
    rows = spark.createDataFrame([(1, "Hello world. Bye", "en", 1.5, 0, tokens, stamps), (2, "", "", 0.0, 0, [], [])], schemas.RESULTS).withColumn("response_format", F.lit("verbose_json"))
    bodies = {r.clip_id: json.loads(r.body) for r in render.render_response(timing.with_timing(rows)).collect()}
    at = [float(np.float32(x)) for x in stamps]
    assert bodies[1] == {
        "task": "transcribe", "text": "Hello world. Bye", "language": "en", "duration": 1.5,
        "words": [{"word": "Hello", "start": 0.0, "end": at[1]}, {"word": "world.", "start": at[1], "end": at[3]}, {"word": "Bye", "start": 1.0, "end": 1.1}],
        "segments": [{"id": 0, "start": 0.0, "end": 1.0, "text": "Hello world."}, {"id": 1, "start": 1.0, "end": 1.1, "text": "Bye"}],
    }
    assert bodies[2] == {"task": "transcribe", "text": "", "language": "", "duration": 0.0}


def test_explode_tokens(spark):
    rows = spark.createDataFrame([(1, "", "", 0.0, 0, ["▁a", "b"], [0.0, 0.1, 0.2]), (2, "", "", 0.0, 0, ["x", "y", "z"], [0.0]), (3, "", "", 0.0, 0, [], [0.0]), (4, "", "", 0.0, 0, None, None)], schemas.RESULTS)
    got = timing.token_intervals(timing.explode_tokens(rows)).orderBy("clip_id", "pos").collect()
    assert [(r.clip_id, r.token) for r in got] == [(1, " a"), (1, "b"), (2, "x")]
    assert got[1].end == pytest.approx(0.2, abs=1e-6)
    assert timing.explode_tokens(rows, strict=True).where("pos = 0 and clip_id = 1").first().token == "▁a"


def test_time_codes(spark):
    cases = [(0.0, "00:00:00,000"), (1.5, "00:00:01,500"), (61.123, "00:01:01,123"), (3661.999, "01:01:01,999"), (7200.0, "02:00:00,000"), (0.001, "00:00:00,001"), (360000.0, "100:00:00,000")]
    df = spark.createDataFrame(cases, "s double, want string")
    for r in df.select("want", timecode.srt_time(F.col("s")).alias("srt"), timecode.vtt_time(F.col("s")).alias("vtt")).collect():
        assert r.srt == r.want and r.vtt == r.want.replace(",", ".")


def test_rendering(spark):
    segments = spark.createDataFrame([(1, 0, 0.0, 2.5, "Hello world."), (1, 1, 3.0, 5.5, "How are you?")], schemas.SEGMENTS)
    assert render.render_srt(segments).first().srt == "1\n00:00:00,000 --> 00:00:02,500\nHello world.\n\n2\n00:00:03,000 --> 00:00:05,500\nHow are you?\n\n"
    assert render.render_vtt(segments).first().vtt == "WEBVTT\n\n00:00:00.000 --> 00:00:02.500\nHello world.\n\n00:00:03.000 --> 00:00:05.500\nHow are you?\n\n"
    clips = spark.createDataFrame([(k, "t<", 1.5, "de", f) for k, f in enumerate(["srt", "vtt", "json", "text", "verbose_json", "odd"], 10)], "clip_id bigint, text string, duration double, language string, response_format string")
    none = timing.nest_timing(clips, spark.createDataFrame([], schemas.WORDS), spark.createDataFrame([], schemas.SEGMENTS))
    bodies = {r.response_format: r.body for r in render.render_response(none).collect()}
    assert bodies == {"srt": "", "vtt": "WEBVTT\n\n", "json": '{"text":"t<"}', "text": "t<", "verbose_json": '{"duration":1.5,"language":"de","task":"transcribe","text":"t<"}', "odd": '{"text":"t<"}'}


def test_sniff_format(spark):
    cases = [
        (b"RIFF\0\0\0\0WAVEfmt ", "wav"), (b"ID3\x04", "mp3"), (b"fLaC", "flac"), (b"OggS", "ogg"), (b"\x1a\x45\xdf\xa3", "webm"), (b"\0\0\0\x20ftypM4A", "m4a/mp4"),
        (b"\xff\xfb\x90\x00", "mp3"), (b"\xff\xf1\x50\x80", "aac"), (b"\xff\xe2\xf0\x00", None), (b"\xff\xfb\x90", None), (bytes.fromhex("DEADBEEF01020304"), None), (b"\x01", None), (b"", None), (None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = [r.f for r in df.select("i", audio.sniff_format(F.col("content")).alias("f")).orderBy("i").collect()]
    assert got == [want for _, want in cases]


def test_gate(spark):
    rows = [(1, 10, "wav", 1_599), (2, 10, "wav", 1_600), (3, 10, "wav", 9_600_000), (4, 10, "wav", 9_600_001), (5, 10, "wav", 13_107_201), (6, 10, None, 1_600), (7, 101 * 2**20, "wav", 1_600), (8, 10, "wav", None)]
    df = spark.createDataFrame(rows, "clip_id int, length bigint, format string, n_samples bigint")
    got = {r.clip_id: (r.outcome.code, r.outcome.message) for r in intake.gate(df).collect()}
    assert [got[i][0] for i in range(1, 9)] == [400, 200, 200, 413, 400, 400, 400, 400]
    assert got[4][1] == "audio duration 600s exceeds limit of 600s" and "100ms" in got[1][1]
    valid, rejects = intake.split_by_outcome(intake.gate(df))
    assert valid.count() == 2 and '"code":413' in rejects.where("clip_id = 4").first().body
    with pytest.raises(ValueError):
        Limits(max_queue=-1)


def test_labels(spark):
    df = spark.createDataFrame([("upstream-id-123", "", "k"), ("", "litellm call/456", "k"), (None, None, "k"), ("???", "x", "k"), ("a" * 200, "", "k")], "h string, c string, k string")
    got = [r[0] for r in df.select(labels.request_id(F.col("h"), F.col("c"), F.col("k"))).collect()]
    assert got[:2] == ["upstream-id-123", "litellmcall456"] and got[2] == got[3] and len(got[2]) == 36 and len(got[4]) == 128
    df = spark.createDataFrame([("de",), ("xx",), ("unknown",), (None,)], "l string")
    assert [r[0] for r in df.select(labels.sanitize_lang(F.col("l"))).collect()] == ["de", "other", "unknown", "other"]
    df = spark.createDataFrame([("00-" + "a" * 32 + "-" + "b" * 16 + "-01",), ("00-" + "0" * 32 + "-" + "b" * 16 + "-01",), ("x",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(labels.trace_context(F.col("t"))).collect()]
    assert got == [("a" * 32, "b" * 16), (None, None), (None, None), (None, None)]


def test_decode(spark):
    frames = spark.createDataFrame([(1, i, [float(k == t) for k in range(4)]) for i, t in enumerate([1, 1, 0, 1, 2, 2, 0])], schemas.FRAMES)
    vocabulary = spark.createDataFrame([(0, "<blk>"), (1, "▁a")], schemas.VOCABULARY)
    got = engines.ctc_engine(frames, vocabulary, 0).first()
    assert got.tokens == ["▁a", "▁a", "<unk>"] and got.text == "a a<unk>" and [round(t, 2) for t in got.timestamps] == [0.0, 0.24, 0.32]
    assert decode.detect_blank_id(vocabulary).first().blank_id == 0
    assert decode.detect_blank_id(spark.createDataFrame([(0, "a"), (7, "b")], schemas.VOCABULARY)).first().blank_id == 7
    padded = decode.frame_argmax(frames).withColumn("n_valid", F.lit(2))
    assert decode.ctc_collapse(padded, 0).count() == 1


def test_pcm(spark):
    df = spark.createDataFrame([(1, bytes.fromhex("0000FF7F0080")), (2, b"\x01"), (3, None)], "clip_id bigint, pcm binary")
    got = {r.clip_id: r.samples for r in features.pcm16_to_float(df).collect()}
    assert got[1][:2] == [0.0, 1.0] and got[1][2] == pytest.approx(-1.0000305) and got[2] == [] and got[3] is None
    back = features.unpack_f32le(features.pack_f32le(spark.createDataFrame([(1, [0.5, -1.0])], "clip_id bigint, samples array<float>")))
    assert back.first().samples == [0.5, -1.0]


def wav(samples, rate=16_000, channels=1):
    data = np.array(samples, "<i2").tobytes()
    fmt = (1).to_bytes(2, "little") + channels.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * 2).to_bytes(4, "little") + b"\x02\0\x10\0"
    return b"RIFF\0\0\0\0WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"data" + len(data).to_bytes(4, "little") + data


def test_wav_corpus(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([0, 32767]))
    (tmp_path / "b.wav").write_bytes(wav([0, 1], rate=8_000))
    (tmp_path / "c.txt").write_bytes(b"no audio")
    corpus = scans.scan_audio_corpus(spark, str(tmp_path))
    samples, rest = features.wav_corpus_to_samples(corpus)
    assert [r.samples for r in samples.collect()] == [[0.0, 1.0]] and rest.count() == 2
    assert scans.scan_audio_corpus(spark, str(tmp_path), "*.wav").count() == 2
    assert intake.pending_clips(corpus, corpus.where("path like '%a.wav'")).count() == 2
    manifest = spark.createDataFrame([(corpus.where("path like '%a.wav'").first().path,), ("gone",)], "path string")
    assert sorted(r.has_file for r in intake.attach_manifest(manifest, corpus).collect()) == [False, True]


@pytest.mark.parametrize("flavor", ["torch", "tdt"])
def test_log_mel(spark, flavor):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2_000).astype(np.float32)
    df = spark.createDataFrame([(1, 16_000, x.tolist()), (2, 16_000, [0.1] * 10), (3, 16_000, None)], schemas.SAMPLES)
    got = features.log_mel(df, flavor).orderBy("clip_id", "frame").collect()
    n_mels, centered = features.FLAVORS[flavor]
    mel = np.array([r.mel for r in got if r.clip_id == 1])
    assert mel.shape == (1 + 2_000 // 160, n_mels) and [r.mel for r in got if r.clip_id == 2] == [[0.0] * n_mels]
    padded, bank = np.pad(x.astype(float), 256, mode="reflect"), features.mel_filterbank(n_mels)
    window = np.hanning(401)[:-1]
    for k in (0, 5, 12):
        frame = np.zeros(512)
        piece = padded[k * 160 : k * 160 + 512]
        if centered:
            frame[56:456] = piece[56:456] * window
        else:
            frame[:400] = piece[:400] * window
        dft = np.array([(frame * np.exp(-2j * np.pi * f * np.arange(512) / 512)).sum() for f in range(257)])
        assert np.allclose(mel[k], np.log(np.maximum(bank @ np.abs(dft) ** 2, 1e-5)), atol=1e-3)
    assert {r.clip_id: r.frames for r in features.frame_counts(df).collect()} == {1: 13, 2: 1}


def test_feature_statistics(spark):
    df = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(3)], schemas.FEATURES)
    for flavor, deviation in (("torch", 1.0), ("tdt", np.sqrt(2 / 3))):
        got = {(r.frame, r.bin): r.value for r in features.normalize_per_feature(features.explode_bins(df), flavor).collect()}
        assert got[2, 0] == pytest.approx(1 / (deviation + 1e-5)) and got[0, 1] == 0
    long = features.pad_to_length(df, 5, 2).orderBy("frame").collect()
    assert [r.mel for r in long][3:] == [[0.0, 0.0]] * 2 and {r.n_valid for r in long} == {3} and not long[0].truncated
    assert [r.frame for r in features.pad_to_length(df, 2, 2).where("truncated").orderBy("frame").collect()] == [0, 1]


def test_engines(spark):
    class Failing(engines.EchoEngine):
        def transcribe(self, samples, sample_rate):
            if samples[0] < 0:
                raise RuntimeError("broken")
            return {}

    df = spark.createDataFrame([(1, 16_000, [0.0] * 1_600), (2, 16_000, []), (3, 16_000, [-1.0])], schemas.SAMPLES)
    echo = {r.clip_id: r.text for r in engines.transcribe(df, engines.engine("echo")).collect()}
    assert echo == {1: "[echo] 1600 samples at 16000Hz, 0.1s", 2: "", 3: "[echo] 1 samples at 16000Hz, 0.0s"}
    assert {r.clip_id: r.text for r in engines.echo_results(df).collect()} == echo
    failed = {r.clip_id: r for r in engines.transcribe(df, Failing).collect()}
    assert failed[3].error == "RuntimeError: broken" and failed[1].error is None and failed[1].tokens == []
    assert engines.smoke_test(engines.engine("echo"))["language"] == "en"
    with pytest.raises(ValueError):
        engines.engine("none")


def test_registry(spark):
    frames = spark.createDataFrame([(1, i, [float(k == t) for k in range(3)]) for i, t in enumerate([1, 1, 0, 2])], schemas.FRAMES)
    vocabulary = spark.createDataFrame([(0, "<blk>"), (1, "▁a"), (2, "b")], schemas.VOCABULARY)
    got = engines.transcribe(frames, engines.engine("ctc", vocabulary=vocabulary, blank_id=0)).first()
    assert (got.text, got.tokens, got.error) == ("ab", ["▁a", "b"], None)

    class Own(engines.EchoEngine):
        def __init__(self, word="x"):
            self.word = word

        def transcribe(self, samples, sample_rate):
            return {"text": self.word}

    engines.register("own", lambda word: lambda: Own(word))
    try:
        df = spark.createDataFrame([(1, 16_000, [0.0]), (2, 16_000, None)], schemas.SAMPLES)
        assert sorted(r.text for r in engines.transcribe(df, engines.engine("own", word="hi")).collect()) == ["", "hi"]
        with pytest.raises(ValueError):
            engines.register("own", lambda: Own)
    finally:
        del engines.REGISTRY["own"]


def test_detokenize_variants(spark):
    ids = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 2)], "clip_id bigint, pos int, token_id int")
    vocabulary = spark.createDataFrame([(1, "▁a"), (2, "▁b")], schemas.VOCABULARY)
    assert decode.detokenize(decode.lookup_tokens(ids, vocabulary)).first().text == "a<unk> b"
    assert decode.detokenize(decode.lookup_tokens(ids, vocabulary, "")).first().text == "a b"
    rows = spark.createDataFrame([(["▁a", None, "▁b"],), ([],), (None,)], "tokens array<string>")
    assert [r[0] for r in rows.select(decode.detokenize_array("tokens")).collect()] == ["a b", "", None]


def test_filterbank_by_hand():
    """Triangles worked out bin by bin."""
    bank, n = features.mel_filterbank(4, 16_000, 32), 17
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = [700 * (10 ** (mel(8_000) * i / 5 / 2595) - 1) for i in range(6)]
    for m in range(4):
        low, mid, high = edges[m : m + 3]
        for k in range(n):
            hz = 500 * k
            up, down = (hz - low) / (mid - low), (high - hz) / (high - mid)
            assert bank[m, k] == pytest.approx(max(0.0, min(up, down)) / (high - low), abs=1e-9)


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"path":"a.wav","filename":"a","language":"de","response_format":"srt","request_id":"r","odd":1}\n{"path":"b.wav"}\n')
    assert {(r.path, r.language, r.litellm_call_id) for r in scans.scan_manifest(spark, str(tmp_path / "m.json")).collect()} == {("a.wav", "de", None), ("b.wav", None, None)}
    results = spark.createDataFrame([(1, "t", "de", 1.0, 5, ["▁a"], [0.0])], schemas.RESULTS)
    results.write.parquet(str(tmp_path / "results"))
    assert scans.scan_results(spark, str(tmp_path / "results")).collect() == results.collect()
    (tmp_path / "s.json").write_text('{"trace_id":"t","span_id":"s","name":"transcribe","start_ts":"2024-01-01T00:00:00Z","end_ts":"2024-01-01T00:00:02Z"}\n{"trace_id":"t","span_id":"x","parent_id":"s","name":"audio.decode","start_ts":"2024-01-01T00:00:00Z","end_ts":"2024-01-01T00:00:01Z"}\n')
    got = logs.span_breakdown(scans.scan_spans(spark, str(tmp_path / "s.json"))).first()
    assert (got.total_us, got.decode_us, got.inference_us, got.other_us) == (2_000_000, 1_000_000, 0, 1_000_000)


def test_odd_white_space_in_vocabularies(spark, tmp_path):
    (tmp_path / "lines.txt").write_bytes("a\x85 1\nb\xa0c 2\nd\x0be 3\r\n\x1cf\x7f\n \t\n\x00g\x9f x\rh\n".encode())
    got = [(r.token_id, r.token) for r in scans.scan_vocab_lines(spark, str(tmp_path / "lines.txt")).orderBy("token_id").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "d"), (3, "f"), (4, ""), (5, "g"), (6, "h")]
    (tmp_path / "pairs.txt").write_bytes("\ta 5\n\xa0b\u30006\x85\nlonely\t\nc\td 1\n".encode())
    assert sorted((r.token_id, r.token) for r in scans.scan_vocab_pairs(spark, str(tmp_path / "pairs.txt")).collect()) == [(5, "a"), (6, "b")]


def test_vocabularies(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a 1\n\n\x01b\n<blk>\n")
    (tmp_path / "pairs.txt").write_text("a 0\nlonely\nb 1\n")
    assert [(r.token_id, r.token) for r in scans.scan_vocab_lines(spark, str(tmp_path / "lines.txt")).orderBy("token_id").collect()] == [(0, "a"), (1, ""), (2, "b"), (3, "<blk>")]
    assert [(r.token_id, r.token) for r in scans.scan_vocab_pairs(spark, str(tmp_path / "pairs.txt")).orderBy("token_id").collect()] == [(0, "a"), (1, "b")]


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text('time=2024-01-01T00:00:00Z level=INFO msg=transcribed file="a b.mp3" duration_s=3.8 elapsed_ms=268 lang=de\nbroken\n')
    got = scans.scan_request_logs(spark, str(tmp_path / "x.log"), "text").where("level = 'INFO'").first()
    assert (got.file, got.duration_s, got.elapsed_ms, got.lang, got.status) == ("a b.mp3", "3.8", 268, "de", None)
    lines = spark.createDataFrame([('{"level":"INFO","elapsed_ms":268}',), ("{bad",)], "value string")
    assert sorted(scans.parse_request_logs(lines, "json").select("elapsed_ms").toPandas().elapsed_ms.fillna(-1)) == [-1, 268]
    levels = spark.createDataFrame([("debug",), ("INFO",), ("warn",), ("ERROR",), ("odd",), (None,)], "level string")
    assert logs.filter_level(levels, "warn").count() == 2 and logs.filter_level(levels, "").count() == 3
    with pytest.raises(ValueError):
        logs.filter_level(levels, "loud")
    with pytest.raises(ValueError):
        scans.parse_request_logs(lines, "xml")


def test_models(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "tokens.txt").write_text("a 0\n")
    (good / "model.onnx").write_bytes(b"\x08\x07" + bytes(2**20))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "model.onnx").write_bytes(b"\x08\x07")
    inventory = scans.scan_model_inventory(spark, str(tmp_path), checksums=True)
    assert {r.model_dir: (r.ok, r.reason) for r in models.model_integrity(inventory).collect()} == {"good": (True, None), "bad": (False, "tokens.txt not found")}
    assert {r.model_dir: r.model_type for r in models.model_type_of(inventory).collect()} == {"good": "nemo_ctc", "bad": None}
    pins = inventory.where("model_dir = 'good'").select("model_dir", "file", F.expr("if(file = 'tokens.txt', sha256, 'other')").alias("sha256"))
    assert sorted(r.status for r in models.checksum_status(inventory, pins).collect()) == ["match", "mismatch", "unpinned"]


def test_gauge_and_histogram(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 03:00:00"), ("2024-01-01 02:30:00", "2024-01-01 02:45:00"), ("2024-01-01 02:45:00", "2024-01-01 02:50:00")], "start string, stop string").selectExpr("cast(start as timestamp)", "cast(stop as timestamp)")
    assert [r.level for r in metrics.gauge(rows).orderBy("at").collect()] == [1, 2, 2, 1, 0]
    values = spark.createDataFrame([(0.05,), (0.1,), (40.0,), (None,)], "x double")
    got = {(r.name, r.le): r.value for r in metrics.histogram(values, F.col("x"), metrics.REQUEST_BUCKETS, "h").collect()}
    assert got["h_bucket", "0.1"] == 2 and got["h_bucket", "30"] == 2 and got["h_bucket", "+Inf"] == 3 and got["h_count", None] == 3
    none = {(r.name, r.le): r.value for r in metrics.histogram(values.where("x > 99"), F.col("x"), (1.0,), "h").collect()}
    assert none["h_sum", None] == 0 and none["h_bucket", "+Inf"] == 0


def test_overload_carries_levels(spark):
    """A request open over days counts in each, with or without arrivals there."""
    rows = [("r1", "2024-01-01 23:00:00", 3 * 86_400.0, 200), ("r2", "2024-01-05 01:00:00", 60.0, 429)]
    facts = spark.createDataFrame(rows, "request_id string, at string, inference_s double, status int")
    facts = facts.select("request_id", F.col("at").cast("timestamp").alias("arrival"), F.lit(0.0).alias("queue_s"), F.lit(0.0).alias("decode_s"), "inference_s", "status")
    got = [(str(r.window_start)[:10], r.requests, r.rejected, r.peak_in_progress) for r in metrics.overload_report(facts).orderBy("window_start").collect()]
    assert got == [("2024-01-01", 1, 0, 1), ("2024-01-02", 0, 0, 1), ("2024-01-03", 0, 0, 1), ("2024-01-04", 0, 0, 1), ("2024-01-05", 1, 1, 0)]
    assert metrics.overload_report(facts.limit(0)).count() == 0


def test_histograms_in_one_pass(spark, data_dir):
    from auricle.plans import views

    facts = views.facts(spark, data_dir)
    one = {(r.name, r.le): r.value for r in metrics.histograms(facts).collect()}
    each = {(r.name, r.le): r.value for h in (metrics.request_duration, metrics.decode_duration, metrics.inference_duration, metrics.audio_duration) for r in h(facts).collect()}
    assert one.pop(("audio_bytes_total", None)) == metrics.audio_bytes_total(facts).first().value
    assert one == pytest.approx(each)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "de", "a"), (2, "xx", "b")], "clip_id bigint, language string, text string")
    write_transcripts(df, str(tmp_path / "t"))
    assert {r.lang for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"de", "other"}
    timed = timing.with_timing(spark.createDataFrame([(1, "a", "de", 1.0, 0, [" a"], [0.0])], schemas.RESULTS)).withColumn("body", render.srt(F.col("segments")))
    write_transcripts(timed, str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w")).first()
    assert stored.words[0].word == "a" and stored.segments[0].text == "a" and stored.body.startswith("1\n00:00:00,000")
    _, rejects = intake.split_by_outcome(intake.gate(spark.createDataFrame([(1, 10, "wav", 5), (2, 10, "wav", 9_600_001)], "clip_id int, length bigint, format string, n_samples bigint")))
    write_rejects(rejects, str(tmp_path / "r"))
    assert {r.code for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {400, 413}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav([0] * 2_000))
    (tmp_path / "in" / "b.bin").write_bytes(b"nothing")
    clips = jobs.stream_audio_corpus(spark, str(tmp_path / "in")).withColumn("n_samples", F.floor((F.col("length") - 44) / 2))
    jobs.stream_intake(clips, str(tmp_path / "ok"), str(tmp_path / "no"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "no")).count() == 1
    raw = jobs.stream_audio_corpus(spark, str(tmp_path / "in"))
    jobs.stream_intake(raw, str(tmp_path / "ok2"), str(tmp_path / "no2"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok2")).first().n_samples == 2_000 and spark.read.parquet(str(tmp_path / "no2")).count() == 1
    facts = spark.createDataFrame([("r1", "2024-01-01 00:00:00", 200), ("r2", "2024-01-01 05:00:00", 400)], "request_id string, at string, status int")
    full = facts.select("request_id", F.col("at").cast("timestamp").alias("arrival"), *(F.lit(0.1).alias(c) for c in ("queue_s", "decode_s", "inference_s", "duration_s")), F.lit(1).cast("bigint").alias("size_bytes"), F.lit(1).cast("bigint").alias("n_samples"), F.lit("de").alias("model_lang"), F.lit("").alias("hint"), "status")
    full.write.parquet(str(tmp_path / "facts"))
    stream = jobs.stream_request_facts(spark, str(tmp_path / "facts"))
    jobs.stream_windowed(stream, "1 hour", "30 minutes").writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").where("status = 200").count() == 2
    ended = stream.select("request_id", F.col("arrival").alias("ended")).where("request_id = 'r2'")
    late = jobs.stream_timeouts(stream.select("request_id", F.col("arrival").alias("started")), ended)
    late.writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start().awaitTermination()
    assert [r.request_id for r in spark.table("late").collect()] == ["r1"]
    batch = jobs.stream_timeouts(full.select("request_id", F.col("arrival").alias("started")), full.select("request_id", F.col("arrival").alias("ended")).where("request_id = 'r2'"))
    assert [r.request_id for r in batch.collect()] == ["r1"]
