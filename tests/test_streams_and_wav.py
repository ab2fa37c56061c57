"""Streams across restarts and late rows, and WAV clips found in column expressions."""

import datetime as dt
import random

import duckdb
import pytest
from conftest import comparable
from pyspark.sql import functions as F
from test_transcripts import wav

from auricle.functions.audio import FIRST_CHUNKS, wav_pcm, wav_sample_count
from auricle.operators import features
from auricle.plans import queries, sql
from auricle.streaming import jobs

START = dt.datetime(2024, 5, 1)


def chunk(name, body, size=None):
    return name + (len(body) if size is None else size).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def plain_data(raw):
    """Sample bytes by a loop over the chunks."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, good = 12, False
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            good = (body[:4] + body[4:8] + body[14:16]) == b"\1\0\1\0" + (16_000).to_bytes(4, "little") + b"\x10\0"
        elif name == b"data":
            return body if good else None
        at += 8 + size + size % 2
    return None


def riffs():
    fmt = wav([])[20:36]
    head = b"RIFF\0\0\0\0WAVE"
    r = random.Random(1)
    found = [None, b"", b"RIFF", head, head + b"dat", wav([1, 2, 3]), wav([1], rate=8000), wav([1], channels=2), wav([5, 6])[:-1], head + chunk(b"data", b"abcd") + chunk(b"fmt ", fmt)]
    found += [head + chunk(b"fmt ", fmt) + chunk(b"data", b"abcd", 2**32 - 1), head + chunk(b"LIST", b"x", 2**32 - 1) + chunk(b"fmt ", fmt) + chunk(b"data", b"ab")]
    found += [head + chunk(b"fmt ", fmt[:15]) + chunk(b"data", b"ab"), head + chunk(b"fmt ", fmt) + chunk(b"fmt ", b"\2" + fmt[1:]) + chunk(b"data", b"ab"), head + chunk(b"fmt ", fmt) + chunk(b"data", b"")]
    found.append(head + chunk(b"junk", b"") * (3 * FIRST_CHUNKS) + chunk(b"fmt ", fmt) + chunk(b"data", b"far away"))
    for _ in range(60):
        parts = [chunk(r.choice([b"LIST", b"fact", b"JUNK"]), bytes(r.randrange(256) for _ in range(r.randrange(9)))) for _ in range(r.randrange(4))] + [chunk(b"fmt ", fmt + b"\0\0" * r.randrange(2))]
        r.shuffle(parts)
        whole = head + b"".join(parts) + chunk(b"data", bytes(r.randrange(256) for _ in range(r.randrange(30)))) + chunk(b"LIST", b"end")
        found.append(whole[: r.randrange(len(whole))] if r.random() < 0.3 else whole)
    return found


def test_wav_data(spark):
    raws = riffs()
    df = spark.createDataFrame(list(enumerate(raws)), "i int, content binary")
    rows = df.select("i", wav_pcm(F.col("content")).alias("pcm"), wav_sample_count(F.col("content")).alias("n")).collect()
    for row in rows:
        want = None if raws[row.i] is None else plain_data(raws[row.i])
        assert (None if row.pcm is None else bytes(row.pcm)) == want
        assert row.n == (None if want is None else len(want) // 2)
    assert sum(r.n is not None for r in rows) > 30


def test_wav_corpus_reads_samples_alone(spark):
    """Only sample bytes are handed to Python, and clips that need a decoder not at all."""
    clips = spark.createDataFrame([(f"c{i}", raw) for i, raw in enumerate(riffs())], "path string, content binary")
    samples, rest = features.wav_corpus_to_samples(clips)
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "content" not in line and "pcm" in line
    assert "MapInArrow" not in rest._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in features.count_wav_samples(clips)._jdf.queryExecution().optimizedPlan().toString()
    assert samples.count() + rest.count() == len(riffs())


# Intake across restarts


def write_clips(folder, names):
    for name in names:
        (folder / name).write_bytes(wav(range(2000)) if name.startswith("good") else wav([1, 2]) if name.startswith("short") else b"no audio")


def drained(query):
    query.awaitTermination()
    assert query.exception() is None


def test_intake_fails_between_its_sinks(spark, tmp_path, monkeypatch):
    """A batch whose rejects were not written is run again whole; its clips are in one sink, once."""
    source = tmp_path / "in"
    source.mkdir()
    valid, rejects, state = (str(tmp_path / x) for x in ("valid", "rejects", "state"))
    write_clips(source, ["good1.wav", "short1.wav", "bad1.bin"])
    drained(jobs.stream_intake(jobs.stream_audio_corpus(spark, str(source)), valid, rejects, state))
    write_clips(source, ["good2.wav", "good3.wav", "bad2.bin"])
    real = jobs._write_batch

    def failing(rows, path, batch_id):
        if path == rejects:
            raise OSError("lost between the sinks")
        real(rows, path, batch_id)

    monkeypatch.setattr(jobs, "_write_batch", failing)
    with pytest.raises(Exception, match="lost between the sinks"):
        jobs.stream_intake(jobs.stream_audio_corpus(spark, str(source)), valid, rejects, state).awaitTermination()
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    ok, bad = jobs.read_intake(spark, valid, rejects)
    assert names(ok) == ["good1.wav"] and names(bad) == ["bad1.bin", "short1.wav"]  # the second batch is half written
    monkeypatch.setattr(jobs, "_write_batch", real)
    write_clips(source, ["good4.wav"])
    for _ in range(2):
        drained(jobs.stream_intake(jobs.stream_audio_corpus(spark, str(source)), valid, rejects, state))
        ok, bad = jobs.read_intake(spark, valid, rejects)
        assert names(ok) == ["good1.wav", "good2.wav", "good3.wav", "good4.wav"] and names(bad) == ["bad1.bin", "bad2.bin", "short1.wav"]


def test_intake_fails_after_both_sinks(spark, tmp_path, monkeypatch):
    """A batch that both sinks hold, but no checkpoint, is not written again."""
    source = tmp_path / "in"
    source.mkdir()
    valid, rejects, state = (str(tmp_path / x) for x in ("valid", "rejects", "state"))
    write_clips(source, ["good1.wav", "bad1.bin"])
    real, written = jobs._write_batch, []

    def failing(rows, path, batch_id):
        real(rows, path, batch_id)
        written.append((path, batch_id))
        if path == rejects:
            raise OSError("lost before the checkpoint")

    monkeypatch.setattr(jobs, "_write_batch", failing)
    with pytest.raises(Exception, match="lost before the checkpoint"):
        jobs.stream_intake(jobs.stream_audio_corpus(spark, str(source)), valid, rejects, state).awaitTermination()
    drained(jobs.stream_intake(jobs.stream_audio_corpus(spark, str(source)), valid, rejects, state))
    assert written == [(valid, 0), (rejects, 0)]
    ok, bad = jobs.read_intake(spark, valid, rejects)
    assert ok.count() == 1 and bad.count() == 1
    assert jobs.read_intake(spark, str(tmp_path / "none"), str(tmp_path / "none")) is None


# Earliest records


class Feed:
    """A folder of Parquet files that a stream reads one a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder / "feed"), schema, 0

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/part={self.n:03}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.folder)


def run_append(spark, stream, folder, conf=None):
    for key, value in (conf or {}).items():
        spark.conf.set(key, value)
    try:
        drained(stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start())
    finally:
        for key in conf or {}:
            spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(str(folder / "out"))


def test_stream_dedupe_gives_the_earliest(spark, tmp_path):
    """Across batches and a restart: the earliest of late copies, whole; copies later than the watermark are dropped; a record further off is its own."""
    at = lambda m: START + dt.timedelta(minutes=m)
    feed = Feed(spark, tmp_path, "request_id string, time timestamp, value string, n int")
    dedupe = lambda: jobs.stream_dedupe(feed.stream(), delay="10 minutes")
    feed.put([("a", at(5), "second", 1), ("b", at(6), "only", None), ("n", None, "no time", 3)])
    feed.put([("a", at(2), "first, late", 2), ("a", at(7), None, 3)])
    first = run_append(spark, dedupe(), tmp_path, jobs.ROCKSDB)
    assert first.count() == 0  # nothing has passed yet
    feed.put([("c", at(14), "c", 1), ("c", at(14), "b", 9)])
    feed.put([("a", at(3), "too late", 4), ("d", at(40), "moves the mark", 5)])
    feed.put([("a", at(41), "another", 6), ("a", at(39), "another, earlier", 7), ("e", at(80), "moves it on", 8)])
    got = {(r.request_id, r.time, r.value, r.n) for r in run_append(spark, dedupe(), tmp_path, jobs.ROCKSDB).collect()}
    assert got == {("a", at(2), "first, late", 2), ("b", at(6), "only", None), ("c", at(14), "b", 9), ("d", at(40), "moves the mark", 5), ("a", at(39), "another, earlier", 7)}


def test_batch_dedupe(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "only"), ("c", None, "no"), ("c", 7, "c")], "request_id string, time int, value string")
    assert {tuple(r) for r in jobs.stream_dedupe(rows).collect()} == {("a", 1, "y"), ("b", None, "only"), ("c", 7, "c")}


def test_stream_timeouts_across_batches(spark, tmp_path):
    """An end in a later batch counts; an unmatched start comes out once both watermarks have passed."""
    at = lambda m: START + dt.timedelta(minutes=m)
    starts, ends = Feed(spark, tmp_path / "s", "request_id string, started timestamp"), Feed(spark, tmp_path / "e", "request_id string, ended timestamp")
    starts.put([("in time", at(0)), ("slow", at(0)), ("never", at(1))])
    ends.put([("other", at(0))])
    starts.put([("open", at(28)), ("mark", at(30))])
    ends.put([("in time", at(4)), ("slow", at(6)), ("mark", at(31))])
    out = run_append(spark, jobs.stream_timeouts(starts.stream(), ends.stream()), tmp_path)
    assert sorted(r.request_id for r in out.collect()) == ["never", "slow"]


def test_stream_dedupe_query_and_sql(spark, tmp_path):
    """Records of a request over a day after a kept one, and ties: the SQL states the stream's rule."""
    day, at = dt.timedelta(days=1), START.replace(microsecond=5)
    times = [0, 0.5, 1.2, 0, 1, 2, 0, 3, 6, 2, 2, 2, 30, 30, 30]  # three to a request, in days
    rows = [(8 + i, at + t * day, i, "click", 1.0 + i) for i, t in enumerate(times, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = comparable(queries.QUERIES["stream_dedupe"](spark, str(tmp_path)).toArrow())
    assert got == comparable(con.execute(sql.ORACLE_SQL["stream_dedupe"]).to_arrow_table())
    kept = [r[0] for r in con.execute(f"SELECT event_id FROM ({sql.ORACLE_SQL['stream_dedupe']}) ORDER BY time, event_id").fetchall()]
    assert sorted(kept) == [9, 11, 12, 14, 15, 16, 17, 18]
