"""Pluggable recognizers applied to every valid clip."""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable, Iterable, Iterator
from multiprocessing.connection import wait
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle import schemas
from auricle.functions.audio import fixed_decimals
from auricle.operators import decode, intake
from auricle.operators.features import float_views
from auricle.schemas import Limits


class Engine(Protocol):
    """A recognizer: one per Python worker."""

    def transcribe(self, samples: np.ndarray, sample_rate: int) -> dict:
        """text, language, inference_ms, tokens, timestamps; missing fields are empty."""

    def model_type(self) -> str: ...

    def close(self) -> None: ...


RESULT_TYPE = pa.struct([("text", pa.string()), ("language", pa.string()), ("duration", pa.float32()), ("inference_ms", pa.int64()), ("tokens", pa.list_(pa.string())), ("timestamps", pa.list_(pa.float32()))])


#: Seconds after which a clip no longer holds up the next one, if a task may have more than one engine.
PATIENCE_S = 0.1


class TimedEngine:
    """An engine in a process of its own, which is killed when a clip takes too long and started again for the next clip."""

    def __init__(self, make_engine: Callable[[], Engine], timeout_s: float, start_s: float = 300) -> None:
        self.make_engine, self.timeout_s, self.start_s = make_engine, timeout_s, start_s
        self.process = None

    def _serve(self, pipe) -> None:
        engine = self.make_engine()
        pipe.send(("ready", None))
        while True:
            clip = pipe.recv()
            if clip is None:
                break
            try:
                pipe.send(("result", engine.transcribe(*clip)))
            except Exception as e:
                pipe.send(("error", f"{type(e).__name__}: {e}"))
        engine.close()

    def _answer(self, limit: float, left: float) -> tuple:
        if not self.pipe.poll(left):
            self._kill()
            raise TimeoutError(f"no answer within {limit:g} s")
        try:
            return self.pipe.recv()
        except EOFError:
            self._kill()
            raise RuntimeError("the engine's process ended") from None

    def _start(self) -> None:
        own = multiprocessing.get_context("fork")
        self.pipe, theirs = own.Pipe()
        self.process = own.Process(target=self._serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()
        self._answer(self.start_s, self.start_s)

    def _kill(self) -> None:
        self.process.kill()
        self.process.join()
        self.pipe.close()
        self.process = None

    def send(self, samples: np.ndarray, sample_rate: int) -> None:
        """Gives the engine a clip, whose time runs from now on; ``take`` has to follow."""
        if self.process is None:
            self._start()
        self.pipe.send((samples, sample_rate))
        self.due = time.monotonic() + self.timeout_s

    def take(self) -> dict:
        """The clip's result; TimeoutError after the limit, or the engine's own failure as RuntimeError."""
        kind, got = self._answer(self.timeout_s, max(0, self.due - time.monotonic()))
        if kind == "error":
            raise EngineError(got)
        return got

    def transcribe(self, samples: np.ndarray, sample_rate: int) -> dict:
        self.send(samples, sample_rate)
        return self.take()

    def close(self) -> None:
        if self.process is not None:
            self.pipe.send(None)
            self.process.join(1)
            self._kill()


class EngineError(Exception):
    """A failure in an engine's own process, in its words."""


def attempt(work: Callable, *given) -> dict | Exception:
    try:
        return work(*given) or {}
    except Exception as e:
        return e


class TimedEngines:
    """Timed engines of a task. A clip without an answer after PATIENCE_S goes on to its own deadline in its process, and the next one goes to another, so waits for clips that hang overlap."""

    def __init__(self, make_engine: Callable[[], Engine], timeout_s: float, most: int = 1) -> None:
        self.engines = [TimedEngine(make_engine, timeout_s) for _ in range(most)]

    def transcribe_all(self, clips: Iterable[tuple[np.ndarray, int]]) -> list[dict | Exception]:
        """Each clip's result or failure, in order; empty clips have an empty one."""
        out, free, busy = [], list(self.engines), {}

        def settle(seconds: float | None = None) -> None:
            """Takes what answers within so long, or else by the next deadline, and what is due."""
            left = min(e.due for e in busy) - time.monotonic()
            ready = wait([e.pipe for e in busy], max(0, left if seconds is None else min(seconds, left)))
            for e in [e for e in busy if e.pipe in ready or e.due <= time.monotonic()]:
                out[busy.pop(e)] = attempt(e.take)
                free.append(e)

        for i, (samples, rate) in enumerate(clips):
            out.append({})
            if not len(samples):
                continue
            engine = free.pop()
            if isinstance(failed := attempt(engine.send, samples, rate), Exception):
                out[i] = failed
                free.append(engine)
                continue
            busy[engine] = i
            settle(PATIENCE_S)
            while not free:
                settle()
        while busy:
            settle()
        return out

    def close(self) -> None:
        for e in self.engines:
            e.close()


def transcribe(samples: DataFrame, make_engine: Callable[[], Engine], timeout_s: float | None = None, keep: tuple[str, ...] = (), at_once: int = 1) -> DataFrame:
    """(clip_id, text, language, duration, inference_ms, tokens, timestamps, error) of samples (clip_id, sample_rate, samples), and the columns ``keep`` as they are.

    ``make_engine`` runs once a task. A clip on which the engine fails keeps its row with
    ``error`` set (the gate makes it a 408), so a job never fails for a clip. With ``timeout_s`` the engine runs in a process beside the task's, and
    a clip that takes longer fails likewise, however the engine hangs; a task may have ``at_once`` such processes, each with an engine, so that clips that hang
    are waited for together. Empty audio gives an
    empty result without calling the engine; no speech gives empty text and no tokens. An engine over
    tables (``TableEngine``) takes its own table instead of samples, and no Python stage.
    """
    if isinstance(make_engine, TableEngine):
        return make_engine.results(samples).withColumn("error", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make_engine() if timeout_s is None else TimedEngines(make_engine, timeout_s, at_once)
        try:
            for batch in batches:
                clips, rates, arrays = batch.column(0).to_pylist(), batch.column(1).to_pylist(), float_views(batch.column(2))
                arrays = [np.zeros(0, np.float32) if x is None else x for x in arrays]
                sent = zip(arrays, rates, strict=True)
                answers = [attempt(engine.transcribe, x, rate) if len(x) else {} for x, rate in sent] if timeout_s is None else engine.transcribe_all(sent)
                results, errors = [], []
                for rate, x, got in zip(rates, arrays, answers, strict=True):
                    error = None
                    if isinstance(got, Exception):
                        error, got = str(got) if isinstance(got, EngineError) else f"{type(got).__name__}: {got}", {}
                    results.append({
                        "text": got.get("text") or "", "language": got.get("language") or "", "duration": float(np.float32(len(x)) / np.float32(rate)) if rate else None,
                        "inference_ms": got.get("inference_ms", 0), "tokens": got.get("tokens") or [], "timestamps": got.get("timestamps") or [],
                    })
                    errors.append(error)
                struct = pa.array(results, RESULT_TYPE)
                yield pa.RecordBatch.from_arrays([pa.array(clips, pa.int64()), *struct.flatten(), pa.array(errors, pa.string()), *batch.columns[3:]], ["clip_id", *(f.name for f in RESULT_TYPE), "error", *keep])
        finally:
            engine.close()

    kept = "".join(f", `{c}` {samples.schema[c].dataType.simpleString()}" for c in keep)
    return samples.select("clip_id", "sample_rate", "samples", *keep).mapInArrow(run, f"{schemas.RESULTS}, error string{kept}")


def transcribe_gated(clips: DataFrame, make_engine: Callable[[], Engine], limits: Limits | None = None, keep: tuple[str, ...] = (), at_once: int = 1) -> DataFrame:
    """Results of all clips and their ``outcome`` (code, type, message), in one plan without a join.

    ``clips`` (clip_id, sample_rate, samples, length, format, n_samples, and what else the gate looks at) pass the gate first; rejected ones never reach the engine. A clip whose
    engine fails, or takes longer than the limits' request timeout, fails the gate's last check: 408.
    """
    limits = limits or Limits()
    gated = intake.gate(clips, limits)
    told = ("malformed", "has_file", "readable", "length", "format", "n_samples")
    sent = gated.withColumn("samples", F.when(F.col("outcome.code") == 200, F.col("samples")))
    done = transcribe(sent, make_engine, limits.request_timeout_s, tuple(dict.fromkeys((*told, *keep))), at_once)
    judged = done.withColumn("inferred", F.col("error").isNull()).withColumn("outcome", intake.intake_outcome(limits))
    return judged.drop(*(c for c in told if c not in keep), "inferred")


def echo_results(samples: DataFrame) -> DataFrame:
    """What the echo engine gives, as column expressions: a line that states samples, rate and seconds."""
    n, rate = F.size("samples"), F.col("sample_rate")
    seconds = fixed_decimals(F.try_divide(n.cast("double"), rate.cast("double")), 1)
    line = F.concat(F.lit("[echo] "), n.cast("string"), F.lit(" samples at "), rate.cast("string"), F.lit("Hz, "), seconds, F.lit("s"))
    return samples.select(
        "clip_id",
        F.when(n > 0, line).otherwise("").alias("text"),
        F.when(n > 0, "en").otherwise("").alias("language"),
        F.try_divide(n.cast("float"), rate.cast("float")).cast("float").alias("duration"),
        F.lit(0).cast("bigint").alias("inference_ms"),
        F.array().cast("array<string>").alias("tokens"),
        F.array().cast("array<float>").alias("timestamps"),
    )


class EchoEngine:
    def transcribe(self, samples: np.ndarray, sample_rate: int) -> dict:
        return {"text": f"[echo] {len(samples)} samples at {sample_rate}Hz, {len(samples) / sample_rate:.1f}s", "language": "en", "inference_ms": 0}

    def model_type(self) -> str:
        return "echo"

    def close(self) -> None:
        pass


class TableEngine:
    """A recognizer that is a query over a table, such as stored logits (clip_id, frame, logits)."""

    def __init__(self, results: Callable[[DataFrame], DataFrame]) -> None:
        self.results = results


def ctc_engine(frames: DataFrame, vocabulary: DataFrame, blank_id: int) -> DataFrame:
    """Results of stored logits: text, tokens and timestamps of each clip; duration from its frames."""
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    decoded = decode.ctc_results(frames, vocabulary, blank_id)
    rows = sizes.join(decoded, "clip_id", "left")
    return rows.select(
        "clip_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit("").alias("language"),
        decode.frame_time(F.col("n")).alias("duration"),
        F.lit(0).cast("bigint").alias("inference_ms"),
        F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        F.coalesce("timestamps", F.array().cast("array<float>")).alias("timestamps"),
    )


#: Engines by name; ``engine`` looks them up, ``register`` adds to them.
REGISTRY: dict[str, Callable[..., Callable[[], Engine] | TableEngine]] = {
    "echo": lambda: EchoEngine,
    "ctc": lambda vocabulary, blank_id: TableEngine(lambda frames: ctc_engine(frames, vocabulary, blank_id)),
}


def register(name: str, make: Callable[..., Callable[[], Engine] | TableEngine]) -> None:
    """Adds an engine under a new name: ``make(**options)`` gives what ``transcribe`` takes."""
    if name in REGISTRY:
        raise ValueError(f"engine {name!r} is there already")
    REGISTRY[name] = make


def engine(name: str, **options) -> Callable[[], Engine] | TableEngine:
    """Factory of a registered engine, for ``transcribe``. "ctc" (vocabulary, blank_id) works on tables of logits."""
    if name not in REGISTRY:
        raise ValueError(f"unknown engine {name!r} (expected one of {', '.join(sorted(REGISTRY))})")
    return REGISTRY[name](**options)


def smoke_test(make_engine: Callable[[], Engine], sample_rate: int = 16_000) -> dict:
    """Result on 1,600 zeros, before a job is started."""
    made = make_engine()
    try:
        return made.transcribe(np.zeros(1_600, np.float32), sample_rate)
    finally:
        made.close()
