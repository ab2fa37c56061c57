"""Steps whose cost grew faster than the input."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auricle.operators import decode, engines, features, timing
from auricle.plans import queries, views


def test_detokenize_exchanges_runs(spark):
    """Tokens in order are one row a run; scattered, repeated and null ones give the same text."""
    rows = spark.range(0, 3000, 1, 1).select(F.expr("id div 1000").alias("clip_id"), F.expr("int(id % 1000)").alias("pos"), F.concat(F.lit(" t"), "id").alias("token"))
    assert decode.packed_runs(rows).count() == 3
    want = {k: " ".join(f"t{i}" for i in range(k * 1000, k * 1000 + 1000)) for k in range(3)}
    for order in (rows, rows.orderBy(F.xxhash64("token"))):
        assert {r.clip_id: r.text for r in decode.detokenize(order).collect()} == want
    odd = spark.createDataFrame([(None, 1, "b"), (None, 0, "a"), (1, 0, "x"), (1, 0, "w"), (1, 1, None), (1, 2, "z")], "clip_id long, pos int, token string")
    assert {r.clip_id: r.text for r in decode.detokenize(odd).collect()} == {None: "ab", 1: "wxz"}


def test_responses_without_an_exchange(spark, data_dir):
    for name in ("render_verbose_json", "render_response"):
        plan = queries.QUERIES[name](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_clips_transformed_together(spark):
    """Short, long and empty clips in one batch have each its own frames."""
    r = np.random.default_rng(1)
    clips = [(i, 16_000, None if n is None else r.integers(-9999, 9999, n).astype("<i2").tobytes()) for i, n in enumerate([0, 399, 400, 5000, None, 200_000, 401, 163_840, 700])]
    for flavor, (n_mels, centered) in features.FLAVORS.items():
        rows = features.log_mel(spark.createDataFrame(clips, "clip_id long, sample_rate int, pcm binary").coalesce(1), flavor, "pcm").orderBy("clip_id", "frame").collect()
        for i, _, raw in clips:
            own = [x for x in rows if x.clip_id == i]
            want = [] if raw is None else features.log_mel_frames(features.pcm16(raw), features.mel_filterbank(n_mels), centered)
            assert [x.frame for x in own] == list(range(len(want)))
            assert not own or np.allclose([x.mel for x in own], want, atol=1e-5)


def test_wav_content_is_made_once(spark, data_dir):
    """No filter below the samples names the content, which would be made anew at each mention."""
    plan = queries.QUERIES["wav_corpus"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "RIFF" in x.upper() or "Filter" in x and "52494646" in x]


def test_slices_by_tokens():
    """Pieces hold at most so many tokens, or one clip."""
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n if n is not None else None for n in (3, 0, None, 9, 1, 1, 1, 1, 2)])], ["tokens"])
    pieces = [p.column(0).to_pylist() for p in timing.slices(batch, 0, 4)]
    assert sum(pieces, []) == batch.column(0).to_pylist()
    assert all(len(p) == 1 or sum(len(x or []) for x in p) <= 4 for p in pieces) and len(pieces) == 4


def test_tokens_are_timed_from_runs(spark, monkeypatch):
    """tokens in long form become a row a run before any exchange; in any order, short clips beside long ones give what the row form gives."""
    texts = {i: [f" w{j}." if j % 7 == 3 else f" w{j}" if j % 3 else "x" for j in range(n)] for i, n in enumerate([0, 1, 40, 900, 2500, 17])}
    rows = spark.createDataFrame([(i, t, [round(0.08 * j + (j % 5 == 0), 2) for j in range(len(t))]) for i, t in texts.items()], "clip_id long, tokens array<string>, timestamps array<float>").coalesce(1)
    tokens = timing.explode_tokens(rows)
    assert timing.packed_runs(tokens).count() == 5
    want = timing.with_timing(rows)
    for ranges in (8192, 100):
        monkeypatch.setattr(timing, "RANGE", ranges)
        assert timing.packed_runs(tokens).where("ranged").count() == (0 if ranges == 8192 else 1)
        for order in (tokens, tokens.repartition(3).orderBy(F.xxhash64("token", "pos"))):
            words, segments = timing.time_tokens(order)
            assert sorted(map(tuple, words.collect())) == sorted(map(tuple, timing.words_of(want).collect()))
            assert sorted(map(tuple, segments.collect())) == sorted(map(tuple, timing.segments_of(want).collect()))


def test_tokens_are_made_once(spark, data_dir):
    """the arrays are made at one place of the plan, also in the form without an exchange."""
    for df in (views.tokens(spark, data_dir), queries.QUERIES["token_intervals"](spark, data_dir)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_long_segments_exchange_no_tokens(spark, data_dir):
    """what is exchanged are runs, and nothing is aggregated or windowed a token at a time."""
    plan = queries.QUERIES["build_segments_long"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1


def test_hanging_clips_are_waited_for_together():
    """each has its own deadline, the others their results, in order; one engine at a time gives the same."""
    clips = [(np.zeros(n, np.float32), 16_000) for n in (5, 211, 422, 0, 7, 212, 633, 844, 9)]
    for most, least, longest in ((8, 1, 2.5), (1, 4, 9)):
        pool = engines.TimedEngines(views.StallingEngine, 1, most)
        began = time.monotonic()
        got = pool.transcribe_all(clips)
        assert least <= time.monotonic() - began < longest
        pool.close()
        assert [type(x).__name__ for x in got] == ["dict", "TimeoutError", "TimeoutError", "dict", "dict", "EngineError", "TimeoutError", "TimeoutError", "dict"]
        assert str(got[1]) == "no answer within 1 s" and str(got[5]) == "ValueError: not in the mood" and got[3] == {} and "7 samples" in got[4]["text"]
