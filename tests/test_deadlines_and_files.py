"""Engines that hang, files above 2 GB, transcripts that are written once."""

import hashlib
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auricle.operators import engines, models
from auricle.schemas import Limits
from auricle.sources import artifacts, scans, sinks


def moody():
    """An engine's class, made here so that workers get it by value."""

    class Moody(engines.EchoEngine):
        """Hangs on clips of 2,000 samples, in a call that no signal ends; dies on 2,001, fails on 2,002."""

        def transcribe(self, samples, sample_rate):
            if len(samples) == 2000:
                while True:
                    try:
                        time.sleep(60)
                    except BaseException:  # noqa: BLE001, S110
                        pass
            if len(samples) == 2001:
                os._exit(3)
            if len(samples) == 2002:
                raise ValueError("no")
            return super().transcribe(samples, sample_rate)

    return Moody


def clips_of(spark, sizes):
    rows = [(i, 16_000, [0.5] * n, "wav", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "clip_id long, sample_rate int, samples array<float>, format string, n_samples long")
    return df.withColumn("length", (F.col("n_samples") * 2).cast("long")).withColumn("extra", F.col("clip_id").cast("string"))


def test_hanging_engine_gives_408(spark):
    """One plan, no join: hanging, dying and failing clips are 408, others before and after them 200, rejected ones never reach the engine."""
    sizes = [1700, 2000, 1800, 2001, 1900, 2002, 3000, 10, 0, 2000, 1750]
    clips = clips_of(spark, sizes).coalesce(1)
    got = engines.transcribe_gated(clips, moody(), Limits(request_timeout_s=1), keep=("extra", "n_samples"))
    rows = {r.clip_id: r for r in got.collect()}
    want = {n: 408 if 2000 <= n <= 2002 else 200 if n >= 1600 else 400 for n in sizes}
    assert {i: rows[i].outcome.code for i in rows} == {i: want[n] for i, n in enumerate(sizes)}
    assert rows[1].error == "TimeoutError: no answer within 1 s" and rows[3].error == "RuntimeError: the engine's process ended" and rows[5].error == "ValueError: no"
    assert all(r.outcome.message == "transcription timed out" for r in rows.values() if r.outcome.code == 408)
    assert rows[2].text.startswith("[echo] 1800") and rows[7].text == "" and rows[7].error is None and rows[4].extra == "4"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_timed_engine_starts_again():
    timed = engines.TimedEngine(moody(), 0.5)
    wave = lambda n: np.zeros(n, np.float32)
    assert timed.transcribe(wave(5), 16_000)["language"] == "en"
    first = timed.process.pid
    with pytest.raises(TimeoutError):
        timed.transcribe(wave(2000), 16_000)
    assert timed.transcribe(wave(7), 16_000)["text"].startswith("[echo] 7") and timed.process.pid != first
    with pytest.raises(engines.EngineError, match="ValueError: no"):
        timed.transcribe(wave(2002), 16_000)
    timed.close()
    assert timed.process is None


def test_engine_that_never_starts():
    def make():
        time.sleep(60)

    with pytest.raises(TimeoutError):
        engines.TimedEngine(make, 1, start_s=0.2).transcribe(np.zeros(3, np.float32), 16_000)


def test_transcribe_without_a_deadline_keeps_columns(spark):
    got = engines.transcribe(clips_of(spark, [1700, 0]), engines.EchoEngine, keep=("extra",)).orderBy("clip_id").collect()
    assert [(r.extra, r.text[:6]) for r in got] == [("0", "[echo]"), ("1", "")]


# Model files


def test_sparse_model_of_3_gb(spark, tmp_path):
    """A file larger than a row can hold: length and head are read alone, the checksum is streamed."""
    folder = tmp_path / "big-model"
    folder.mkdir()
    (folder / "tokens.txt").write_text("<blk> 0\n")
    with open(folder / "model.onnx", "wb") as f:
        f.write(b"\x08\x07")
        f.truncate(3 * 2**30)
    (folder / ".hidden").write_text("x")
    (folder / "_tmp").write_text("x")
    inventory = scans.scan_model_inventory(spark, str(tmp_path))
    rows = {r.file: r for r in inventory.collect()}
    assert set(rows) == {"tokens.txt", "model.onnx"} and rows["model.onnx"].length == 3 * 2**30 and bytes(rows["model.onnx"].head) == b"\x08\x07"
    assert [(r.ok, r.reason) for r in models.model_integrity(inventory).collect()] == [(True, None)]
    assert models.model_type_of(inventory).first().model_type == "nemo_ctc"
    want = hashlib.sha256(b"\x08\x07")
    for size in [2**24] * (3 * 2**30 // 2**24 - 1) + [2**24 - 2]:
        want.update(bytes(size))
    summed = scans.scan_model_inventory(spark, str(tmp_path), checksums=True)
    pins = spark.createDataFrame([("big-model", "model.onnx", want.hexdigest().upper()), ("big-model", "tokens.txt", "0")], "model_dir string, file string, sha256 string")
    assert {r.file: r.status for r in models.checksum_status(summed, pins).collect()} == {"model.onnx": "match", "tokens.txt": "mismatch"}


def test_artifact_partitions(tmp_path):
    """Files that are read whole are dealt out by size, others by number."""
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes(bytes(10))
    assert len(artifacts.ArtifactReader(str(tmp_path), True, False).partitions()) == 1
    reader = artifacts.ArtifactReader(f"file://{tmp_path}", False, True)
    try:
        artifacts.TASK_BYTES, before = 25, artifacts.TASK_BYTES
        assert [len(p.files) for p in reader.partitions()] == [2, 2, 1]
        assert {r[1]: r[4] for p in reader.partitions() for r in reader.read(p)} == {f"f{i}": hashlib.sha256(bytes(10)).hexdigest() for i in range(5)}
    finally:
        artifacts.TASK_BYTES = before
    lengths = artifacts.ArtifactReader(str(tmp_path), False, False)
    assert {r[2:] for p in lengths.partitions() for r in lengths.read(p)} == {(10, None, None)}


def test_artifacts_of_an_empty_folder(spark, tmp_path):
    assert scans.scan_model_inventory(spark, str(tmp_path)).count() == 0


# Transcripts


def corpus_of(spark, versions):
    rows = [(f"clip/{k}", v, lang) for k, (v, lang) in versions.items()]
    return spark.createDataFrame(rows, "path string, modificationTime long, language string")


def told(spark, path):
    found = sinks.read_transcripts(spark, path)
    return None if found is None else sorted((r.path, r.modificationTime, r.lang, r.batch) for r in found.collect())


def test_write_pending(spark, tmp_path):
    """Once is twice; new clips and new versions make a batch; a failed run leaves nothing that counts, and the next one writes its batch whole."""
    at, same = str(tmp_path / "out"), lambda clips: clips
    assert told(spark, at) is None
    first = corpus_of(spark, {"a": (1, "en"), "b": (1, "xx")})
    assert sinks.write_pending(first, at, same) == 0
    assert sinks.write_pending(first, at, same) is None
    want = [("clip/a", 1, "en", 0), ("clip/b", 1, "other", 0)]
    assert told(spark, at) == want
    more = corpus_of(spark, {"a": (1, "en"), "b": (2, "de"), "c": (1, "fr"), "d": (1, "en")})

    def failing(clips):
        return clips.withColumn("checked", F.when(F.col("path") == "clip/c", F.raise_error(F.lit("engine lost"))).otherwise(F.lit(1)))

    with pytest.raises(Exception, match="engine lost"):
        sinks.write_pending(more, at, failing)
    assert told(spark, at) == want
    # what a run has left that ended before its commit: a folder of the same batch, with a language that the next run doesn't write
    corpus_of(spark, {"z": (1, "es")}).withColumn("lang", F.lit("es")).withColumn("ingest_date", F.current_date()).write.partitionBy("lang", "ingest_date").parquet(f"{at}/batch=1", mode="overwrite")
    os.remove(f"{at}/batch=1/_SUCCESS")
    assert told(spark, at) == want
    for expected in (1, None):
        assert sinks.write_pending(more, at, same) == expected
        assert told(spark, at) == sorted([*want, ("clip/b", 2, "de", 1), ("clip/c", 1, "fr", 1), ("clip/d", 1, "en", 1)])
