"""Waveforms and log-mel features: Arrow stages for the numerics, windows for statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions.audio import SAMPLE_RATE, wav_pcm, wav_sample_count

# Transform size, window, hop, floor of the power, added to deviations.
N_FFT, WINDOW, HOP = 512, 400, 160
LOG_FLOOR = 1e-5
EPSILON = 1e-5


def _floats(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if a is None else len(a) for a in arrays])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.float32), *(a for a in arrays if a is not None)]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([a is None for a in arrays]))


def float_views(lists: pa.Array) -> list[np.ndarray | None]:
    """Each list of an array of lists of floats as a view of the flat values; None for null."""
    flat = lists.values.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


def _with_array(df: DataFrame, source: str, target: str, convert) -> DataFrame:
    """``df`` with ``target`` array<float>, made of each value of ``source`` (null stays null) in its own small batch."""
    kept = [f for f in df.schema.fields if f.name != target]
    names = [f.name for f in kept]
    at = names.index(source)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{target}` array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 8):
                piece = batch.slice(i, 8)
                made = [None if v is None else convert(v) for v in piece.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, _floats(made)], [*names, target])

    return df.select(*names).mapInArrow(run, schema)


def pcm16(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / np.float32(32767)


def pcm16_to_float(df: DataFrame, column: str = "pcm") -> DataFrame:
    """``samples``: 16-bit little-endian values / 32767; an odd last byte is dropped."""
    return _with_array(df, column, "samples", pcm16)


def unpack_f32le(df: DataFrame, column: str = "payload") -> DataFrame:
    """``samples`` of packed 32-bit little-endian floats; bytes past the last whole one are dropped."""
    return _with_array(df, column, "samples", lambda raw: np.frombuffer(raw[: len(raw) // 4 * 4], "<f4"))


def pack_f32le(df: DataFrame, column: str = "samples") -> DataFrame:
    """``payload``: samples packed as 32-bit little-endian floats."""
    kept = [f for f in df.schema.fields if f.name != "payload"]
    names = [f.name for f in kept]
    at = names.index(column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "payload binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if v is None else v.astype("<f4").tobytes() for v in float_views(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], [*names, "payload"])

    return df.select(*names).mapInArrow(run, schema)


def wav_corpus_to_samples(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, needs_transcode) of clips (path, content): decoded WAV clips, and the paths of all others.

    The sample bytes are found in Spark, so Python gets these alone, and nothing of clips that need a decoder.
    """
    # a row of its own, as a filter on a plain column would be pushed into the clips and make every content anew wherever it is named
    found = clips.select(F.inline(F.array(F.struct("path", wav_pcm(F.col("content")).alias("pcm")))))
    decoded = pcm16_to_float(found.where("pcm is not null")).drop("pcm").withColumn("sample_rate", F.lit(SAMPLE_RATE))
    return decoded, found.where("pcm is null").select("path")


def sample_sums(samples: DataFrame) -> DataFrame:
    """(path, n_samples, total, weighted) of samples (path, samples): their number, the sum of their 16-bit values, and of these times 1 to 1,000 by place, in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                sizes, totals, weighted = [], [], []
                for x in float_views(piece.column(1)):
                    ticks = np.rint(x * np.float32(32767)).astype(np.int64)
                    sizes.append(len(ticks))
                    totals.append(int(ticks.sum()))
                    weighted.append(int(ticks @ (np.arange(len(ticks)) % 1000 + 1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(v, pa.int64()) for v in (sizes, totals, weighted))], ["path", "n_samples", "total", "weighted"])

    return samples.select("path", "samples").mapInArrow(run, "path string, n_samples long, total long, weighted long")


def count_wav_samples(clips: DataFrame) -> DataFrame:
    """``clips`` with n_samples long: samples of 16 kHz mono WAV content; null for any other, which needs a decoder. No Python stage."""
    return clips.withColumn("n_samples", wav_sample_count(F.col("content")))


def mel_filterbank(n_mels: int, sample_rate: int = SAMPLE_RATE, n_fft: int = N_FFT) -> np.ndarray:
    """Triangular filters, evenly spaced in mel = 2595 log10(1 + f / 700), each divided by its width in Hz: (n_mels, n_fft / 2 + 1)."""
    top = 2595 * np.log10(1 + sample_rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    f = np.linspace(0, sample_rate / 2, n_fft // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - low) / (mid - low + 1e-10), (high - f) / (high - mid + 1e-10)), 0, None) / (high - low)


def log_mel_frames(samples: np.ndarray, filters: np.ndarray, centered: bool) -> np.ndarray:
    """(frames, mels): log power of hops of 160 samples, reflect-padded; a clip under one window gives one zero frame.

    The 400-sample window lies in the middle of the 512-point frame, or at its left.
    """
    if len(samples) < WINDOW:
        return np.zeros((1, len(filters)), np.float32)
    return log_mel_of(framed(samples, centered), filters)


def framed(samples: np.ndarray, centered: bool) -> np.ndarray:
    """(frames, WINDOW): the samples that each frame's window covers."""
    x, half = samples.astype(np.float64), N_FFT // 2
    # a clip is shorter than what is reflected only if it is barely a window long
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]])
    shift = (N_FFT - WINDOW) // 2 if centered else 0
    return np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP, shift : shift + WINDOW]


HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)


def log_mel_of(windows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Log power of frames, of one clip or of many. Where the window lies in a frame turns phases alone, which the power does not show."""
    spectrum = np.fft.rfft(windows * HANN, n=N_FFT, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(np.maximum(power @ filters.T, LOG_FLOOR)).astype(np.float32)


#: Frames that are transformed at a time.
FRAMES = 1024
FLAVORS = {"torch": (80, True), "tdt": (128, False)}


def log_mel(samples: DataFrame, flavor: str = "torch", column: str = "samples") -> DataFrame:
    """(clip_id, frame, mel) of (clip_id, sample_rate, samples): 80 bins ("torch") or 128 ("tdt"). Other rates than 16 kHz fail; null samples give no frames.

    ``column`` may also be binary, with 16-bit PCM, which is then read in the same stage.
    """
    packed = samples.schema[column].dataType.simpleString() == "binary"
    n_mels, centered = FLAVORS[flavor]
    shared = samples.sparkSession.sparkContext.broadcast(mel_filterbank(n_mels))

    def rows(clips: list, sizes: list, first: int, mel: np.ndarray) -> pa.RecordBatch:
        """Frames of clips, of so many each, the first clip's from ``first``."""
        ids, frames = np.repeat(np.array(clips, np.int64), sizes), np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        frames[: sizes[0]] += first
        mels = pa.ListArray.from_arrays(pa.array(np.arange(len(mel) + 1, dtype=np.int32) * mel.shape[1]), pa.array(mel.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(frames), mels], ["clip_id", "frame", "mel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            waves = (None if not raw.is_valid else pcm16(raw.as_py()) for raw in batch.column(2)) if packed else iter(float_views(batch.column(2)))
            clips, windows, n = [], [], 0  # short clips are transformed together, FRAMES at a time
            for clip, rate, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), waves, strict=True):
                if x is None:
                    continue
                if rate != SAMPLE_RATE:
                    raise ValueError(f"expected {SAMPLE_RATE} Hz, got {rate} Hz")
                if len(x) < WINDOW:
                    yield rows([clip], [1], 0, np.zeros((1, n_mels), np.float32))
                    continue
                own = framed(x, centered)
                for at in range(0, len(own), FRAMES):
                    part = own[at : at + FRAMES]
                    if len(part) == FRAMES or at:
                        yield rows([clip], [len(part)], at, log_mel_of(part, filters))
                        continue
                    clips.append(clip)
                    windows.append(part)
                    n += len(part)
                if n >= FRAMES:
                    yield rows(clips, [len(w) for w in windows], 0, log_mel_of(np.concatenate(windows), filters))
                    clips, windows, n = [], [], 0
            if n:
                yield rows(clips, [len(w) for w in windows], 0, log_mel_of(np.concatenate(windows), filters))

    return samples.select("clip_id", "sample_rate", column).mapInArrow(run, "clip_id long, frame int, mel array<float>")


def explode_bins(features: DataFrame) -> DataFrame:
    """(clip_id, frame, mel) to (clip_id, frame, bin, value)."""
    return features.select("clip_id", "frame", F.posexplode("mel").alias("bin", "value"))


def normalize_per_feature(bins: DataFrame, flavor: str = "torch") -> DataFrame:
    """``value`` less its mean over (clip_id, bin), over its deviation + 1e-5: sample deviation ("torch") or population ("tdt").

    A single frame has no sample deviation and gives NaN, as the tensor library does.
    """
    own = Window.partitionBy("clip_id", "bin")
    x = F.col("value").cast("double")
    deviation = F.coalesce(F.stddev_samp(x).over(own), F.lit(float("nan"))) if flavor == "torch" else F.stddev_pop(x).over(own)
    return bins.withColumn("value", (x - F.avg(x).over(own)) / (deviation + EPSILON))


def pad_to_length(features: DataFrame, n: int, n_mels: int) -> DataFrame:
    """Exactly ``n`` frames per clip: zero frames are added, later ones cut. n_valid and truncated tell how it was.

    The missing frames are made from one count per clip, so frames themselves are only filtered.
    """
    sizes = features.groupBy("clip_id").agg(F.count("*").alias("n"))
    facts = [F.least("n", F.lit(n)).cast("int").alias("n_valid"), (F.col("n") > n).alias("truncated")]
    kept = features.where(F.col("frame") < n).join(sizes, "clip_id").select("clip_id", "frame", "mel", *facts)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), n_mels)
    added = sizes.where(F.col("n") < n).select("clip_id", F.explode(F.sequence(F.col("n").cast("int"), F.lit(n - 1))).alias("frame"), zeros.alias("mel"), *facts)
    return kept.unionByName(added)


def frame_counts(samples: DataFrame, column: str = "samples") -> DataFrame:
    """Frames that log_mel gives per clip, without computing them or unpacking 16-bit PCM, which ``column`` may also hold."""
    size = F.floor(F.length(column) / 2) if samples.schema[column].dataType.simpleString() == "binary" else F.size(column)
    return samples.where(F.col(column).isNotNull()).select("clip_id", F.when(size < WINDOW, F.lit(1)).otherwise(1 + F.floor(size / HOP)).cast("int").alias("frames"))


def bin_means(bins: DataFrame) -> DataFrame:
    return bins.groupBy("bin").agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count("*").alias("frames"))
