"""Timing of tokens in long form, scanned in ranges, against the row form and plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id

from auricle import schemas
from auricle.operators import timing


def results(spark, seed, n_clips=6, longest=400):
    r = random.Random(seed)
    rows = []
    for clip in range(n_clips):
        n = r.choice([0, 1, 2, longest])
        tokens = [r.choice([" a", "b", " ", "", "c.", " d!", "?", "▁e", " f ", " g"]) for _ in range(n)]
        rows.append((clip, "", "", 0.0, 0, tokens, [round(i * 0.08 + r.random() * 0.01, 3) for i in range(n + r.choice([-1, 0, 0, 1]) if n else 0)]))
    return spark.createDataFrame(rows, schemas.RESULTS)


@pytest.mark.parametrize("size", [1, 2, 7, 50, 8192])
def test_ranges_do_not_show(spark, monkeypatch, size):
    """Whatever the ranges, words and segments are those of the row form."""
    monkeypatch.setattr(timing, "RANGE", size)
    for seed in range(2):
        df = results(spark, seed).cache()
        tokens = timing.explode_tokens(df)
        words, segments = timing.time_tokens(tokens)
        rows = timing.with_timing(df)
        want_words = {tuple(r) for r in timing.words_of(rows).select("clip_id", "word_id", "word", "start", "end").collect()}
        want_segments = {tuple(r) for r in timing.segments_of(rows).select("clip_id", "id", "start", "end", "text").collect()}
        assert {tuple(r) for r in words.select("clip_id", "word_id", "word", "start", "end").collect()} == want_words
        assert {tuple(r) for r in segments.select("clip_id", "id", "start", "end", "text").collect()} == want_segments
        apart = timing.build_words(timing.token_intervals(tokens))
        assert {tuple(r) for r in apart.select("clip_id", "word_id", "word", "start", "end").collect()} == want_words
        df.unpersist()


def test_one_clip_of_half_of_all_tokens(spark, monkeypatch):
    """A clip with half of all tokens is spread over tasks, in every step that sees tokens or words."""
    monkeypatch.setattr(timing, "RANGE", 500)
    n = 20_000
    tokens = spark.range(2 * n).select(
        F.expr(f"if(id < {n}, 0, 1 + id % 100)").alias("clip_id"), F.expr(f"int(if(id < {n}, id, id div 100))").alias("pos"), F.expr("if(id % 3 = 0, ' w', 'x')").alias("token"), (F.col("id") * 0.01).cast("float").alias("ts")
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        intervals = timing.token_intervals(tokens)
        sizes = [r.n for r in intervals.groupBy(spark_partition_id()).agg(F.count("end").alias("n"), F.sum("end")).collect()]
        assert len(sizes) > 8 and sum(sizes) == 2 * n and max(sizes) < n / 2
        words, segments = timing.time_tokens(tokens)
        assert words.where("clip_id = 0").count() == (n + 2) // 3 and segments.where("clip_id = 0").count() == -(-((n + 2) // 3) // 15)
        for part in (words, segments):  # written by the tasks that scanned the ranges
            files = part.where("clip_id = 0").groupBy(F.input_file_name()).count().collect()
            assert len(files) > 8
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_no_tokens(spark):
    words, segments = timing.time_tokens(spark.createDataFrame([], schemas.TOKENS))
    assert words.count() == 0 and segments.count() == 0
    blank = spark.createDataFrame([(1, 0, " ", 0.5), (1, 1, None, None), (2, 0, None, 1.0)], schemas.TOKENS)
    assert timing.time_tokens(blank)[0].count() == 0
    assert [tuple(r)[4:] for r in timing.token_intervals(blank).collect()] == [(0.5, 0.6)]
