"""Service metrics from request facts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions.audio import MIN_SAMPLES
from auricle.functions.labels import resolve_language, sanitize_lang
from auricle.schemas import Limits

# Histogram bounds.
REQUEST_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
DECODE_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)
INFERENCE_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
AUDIO_BUCKETS = (1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
#: Requests that were decoded, also if rejected after that (too short, too long, timed out).
DECODED = f"status in (200, 408, 413) or (status = 400 and n_samples between 1 and {MIN_SAMPLES - 1})"


def with_lang(facts: DataFrame) -> DataFrame:
    """``facts`` with ``lang``: the sanitized language of a success, else empty."""
    lang = sanitize_lang(resolve_language(F.col("model_lang"), F.col("hint")))
    return facts.withColumn("lang", F.when(F.col("status") == 200, lang).otherwise(""))


def requests_total(facts: DataFrame) -> DataFrame:
    return with_lang(facts).groupBy("status", "lang").agg(F.count("*").alias("value"))


def audio_bytes_total(facts: DataFrame) -> DataFrame:
    """Bytes of successful requests."""
    return facts.where("status = 200").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("value"))


def histogram(facts: DataFrame, value: F.Column, buckets: tuple[float, ...], name: str) -> DataFrame:
    """Rows (name, le, value): cumulative counts per bound and +Inf, then sum and count; null values don't count.

    One pass: each bound is a conditional count of the same aggregate, turned into rows afterwards.
    """
    rows = facts.select(value.cast("double").alias("x")).where("x is not null")
    counts = [F.count_if(F.col("x") <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    one = rows.agg(*counts, F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"))
    line = lambda kind, le, v: F.struct(F.lit(f"{name}_{kind}").alias("name"), F.lit(le).cast("string").alias("le"), v.cast("double").alias("value"))
    lines = [line("bucket", f"{b:g}", F.col(f"b{i}")) for i, b in enumerate(buckets)]
    lines += [line("bucket", "+Inf", F.col("n")), line("sum", None, F.col("s")), line("count", None, F.col("n"))]
    return one.select(F.inline(F.array(*lines)))


def bucket_counts(value: F.Column, buckets: tuple[float, ...]) -> list[F.Column]:
    return [F.count_if(value <= b) for b in buckets]


HISTOGRAMS = {
    "request_duration_seconds": REQUEST_BUCKETS,
    "decode_duration_seconds": DECODE_BUCKETS,
    "inference_duration_seconds": INFERENCE_BUCKETS,
    "audio_duration_seconds": AUDIO_BUCKETS,
}


def histogram_value(name: str) -> F.Column:
    """The value that a request adds to a histogram; null if it adds none."""
    ok = F.col("status") == 200
    return {
        "request_duration_seconds": F.when(ok, F.col("decode_s") + F.col("inference_s")),
        "decode_duration_seconds": F.when(F.expr(DECODED), F.col("decode_s")),
        "inference_duration_seconds": F.when(ok, F.col("inference_s")),
        "audio_duration_seconds": F.when(ok, F.col("duration_s")),
    }[name].cast("double")


def histograms(facts: DataFrame) -> DataFrame:
    """(name, le, value) of all four histograms and of audio_bytes_total, from one pass over the facts."""
    aggregates, lines = [], []
    line = lambda name, le, v: F.struct(F.lit(name).alias("name"), F.lit(le).cast("string").alias("le"), v.cast("double").alias("value"))
    for h, (name, buckets) in enumerate(HISTOGRAMS.items()):
        x = histogram_value(name)
        aggregates += [c.alias(f"h{h}_{i}") for i, c in enumerate([*bucket_counts(x, buckets), F.count(x), F.coalesce(F.sum(x), F.lit(0.0))])]
        lines += [line(f"{name}_bucket", le, F.col(f"h{h}_{i}")) for i, le in enumerate([*(f"{b:g}" for b in buckets), "+Inf"])]
        lines += [line(f"{name}_sum", None, F.col(f"h{h}_{len(buckets) + 1}")), line(f"{name}_count", None, F.col(f"h{h}_{len(buckets)}"))]
    aggregates.append(F.coalesce(F.sum(F.when(F.col("status") == 200, F.col("size_bytes"))), F.lit(0)).alias("bytes"))
    return facts.agg(*aggregates).select(F.inline(F.array(*lines, line("audio_bytes_total", None, F.col("bytes")))))


def request_duration(facts: DataFrame) -> DataFrame:
    """Successful requests, from decoding on; time in the queue is not part of it."""
    return histogram(facts.where("status = 200"), F.col("decode_s") + F.col("inference_s"), REQUEST_BUCKETS, "request_duration_seconds")


def decode_duration(facts: DataFrame) -> DataFrame:
    """Every request that was decoded."""
    return histogram(facts.where(DECODED), F.col("decode_s"), DECODE_BUCKETS, "decode_duration_seconds")


def inference_duration(facts: DataFrame) -> DataFrame:
    return histogram(facts.where("status = 200"), F.col("inference_s"), INFERENCE_BUCKETS, "inference_duration_seconds")


def audio_duration(facts: DataFrame) -> DataFrame:
    return histogram(facts.where("status = 200"), F.col("duration_s"), AUDIO_BUCKETS, "audio_duration_seconds")


def gauge(intervals: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """(at, level): how many of the intervals (start, stop) are open, at each instant where that may change.

    A running sum in two steps: changes are summed by instant, then by time bucket; bucket
    totals (few rows) get their running sum, and each bucket runs its own instants from there.
    No window takes in all rows.
    """
    change = lambda column, by: intervals.select(F.col(column).alias("at"), F.lit(by).alias("by"))
    moves = change("start", 1).unionByName(change("stop", -1)).groupBy("at").agg(F.sum("by").alias("by"))
    moves = moves.withColumn("bucket", F.window("at", bucket)["start"])
    totals = moves.groupBy("bucket").agg(F.sum("by").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = moves.join(totals.select("bucket", before.alias("before")), "bucket")
    own = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return levels.select("at", (F.col("before") + F.sum("by").over(own)).alias("level"))


def later(at: F.Column, seconds: F.Column) -> F.Column:
    """A timestamp so many seconds later, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(at) + F.round(seconds * 1_000_000).cast("bigint"))


def in_progress_over_time(facts: DataFrame) -> DataFrame:
    """Requests between taking a slot and their end. Requests that never got a slot (429) are not in it."""
    start = later(F.col("arrival"), F.col("queue_s"))
    return gauge(facts.where("status <> 429").select(start.alias("start"), later(start, F.col("decode_s") + F.col("inference_s")).alias("stop")))


def queued_over_time(facts: DataFrame) -> DataFrame:
    """Requests that wait for a slot."""
    rows = facts.where("status <> 429 and queue_s > 0")
    return gauge(rows.select(F.col("arrival").alias("start"), later(F.col("arrival"), F.col("queue_s")).alias("stop")))


#: Time that instants are folded in before windows: a group holds a million of them at most.
FOLD_S = 1


def _folded(rows: DataFrame, into: str, keep: dict[str, F.Column]) -> DataFrame:
    """Groups of ``into``: the sums of the changes ``busy`` and ``waiting`` and the highest sums of their beginnings in order of ``at``.

    ``rows`` (into, at, busy, busy_top, waiting, waiting_top) are such sums already, so folds nest: tops of the parts,
    each raised by the sums before it. ``keep`` are further aggregates.
    """
    part = F.struct("at", "busy", "busy_top", "waiting", "waiting_top")
    run = lambda acc, x, name: (acc[name] + x[name]).alias(name)
    top = lambda acc, x, name: F.greatest(acc[f"{name}_top"], acc[name] + x[f"{name}_top"]).alias(f"{name}_top")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("busy", "busy_top", "waiting", "waiting_top")])
    grouped = rows.groupBy(into).agg(F.sort_array(F.collect_list(part)).alias("parts"), *[c.alias(name) for name, c in keep.items()])
    sums = F.aggregate("parts", zero, lambda acc, x: F.struct(run(acc, x, "busy"), top(acc, x, "busy"), run(acc, x, "waiting"), top(acc, x, "waiting")))
    return grouped.select(into, sums.alias("sums"), *keep).select(into, "sums.*", *keep)


def overload_report(facts: DataFrame, limits: Limits | None = None, window: str = "1 day") -> DataFrame:
    """Per time window from the first to the last: requests, rejections (429), timeouts in the queue (408), peaks of both gauges, and whether a peak passes its limit.

    A level that a window begins with counts for its peak, so windows without arrivals or changes are there too.

    One scan: each request becomes its changes of both gauges, which are summed by instant (partial sums first, so a crowded instant
    is one row), then folded in order by second and by window into sums and highest levels. No window function sees
    an instant; only window rows, one a window, meet in one task.
    """
    limits = limits or Limits()
    start = later(F.col("arrival"), F.col("queue_s"))
    stop = later(start, F.col("decode_s") + F.col("inference_s"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def move(at: F.Column, busy: F.Column = zero, waiting: F.Column = zero, counts: tuple[F.Column, ...] = (zero, zero, zero)) -> F.Column:
        named = zip(("requests", "rejected", "timed_out"), counts, strict=True)
        return F.struct(F.unix_micros(at).alias("at"), busy.alias("busy"), waiting.alias("waiting"), *[c.alias(n) for n, c in named])

    taken, queued = F.col("status") != 429, (F.col("status") != 429) & (F.col("queue_s") > 0)
    told = (one, (F.col("status") == 429).cast("long"), (F.col("status") == 408).cast("long"))
    moves = F.array(move(F.col("arrival"), waiting=queued.cast("long"), counts=told), F.when(taken, move(start, busy=one, waiting=-queued.cast("long"))), F.when(taken, move(stop, busy=-one)))
    counts = ("requests", "rejected", "timed_out")
    rows = facts.select(F.inline(F.filter(moves, lambda m: m["at"].isNotNull())))
    instants = rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("busy", "waiting", *counts)])
    span = F.window(F.timestamp_micros("at"), window)
    placed = instants.select(F.struct(F.unix_micros(span["start"]).alias("window_start"), F.floor(F.col("at") / (FOLD_S * 1_000_000)).alias("second")).alias("second"), "at", "busy", "waiting", F.unix_micros(span["end"]).alias("window_end"), *counts)
    sums = {c: F.sum(c) for c in counts} | {"window_end": F.max("window_end")}
    tops = [F.col("busy").alias("busy_top"), F.col("waiting").alias("waiting_top")]
    seconds = _folded(placed.select("*", *tops), "second", sums)
    windows = _folded(seconds.select(F.col("second.window_start").alias("window_start"), F.col("second.second").alias("at"), "busy", "busy_top", "waiting", "waiting_top", "window_end", *counts), "window_start", sums)
    order = Window.orderBy("window_start")

    def before(name: str) -> F.Column:
        return F.coalesce(F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    peaks = [(before(n) + F.col(f"{n}_top")).alias(f"{n}_peak") for n in ("busy", "waiting")]
    after = [(before(n) + F.col(n)).alias(f"{n}_after") for n in ("busy", "waiting")]
    step = F.col("window_end") - F.col("window_start")
    known = windows.select("window_start", step.alias("step"), *counts, *peaks, *after, F.coalesce(F.lead("window_start").over(order), F.col("window_end")).alias("next"))
    starts = known.select("*", F.explode(F.sequence(F.col("window_start"), F.col("next") - F.col("step"), F.col("step"))).alias("at"))
    own = F.col("at") == F.col("window_start")
    filled = [F.when(own, F.col(c)).otherwise(0).alias(c) for c in counts]
    levels = [F.when(own, F.col(f"{n}_peak")).otherwise(F.col(f"{n}_after")).alias(name) for n, name in (("busy", "peak_in_progress"), ("waiting", "peak_queued"))]
    return starts.select(F.timestamp_micros("at").alias("window_start"), *filled, *levels).withColumn("over_limit", (F.col("peak_in_progress") > limits.max_concurrent) | (F.col("peak_queued") > limits.max_queue))


def info_labels(limits: Limits, version: str = "dev", commit: str = "none", build_time: str = "unknown") -> dict[str, str]:
    """Labels, as JSON, of the metrics that describe the model and the build."""
    compact = lambda labels: json.dumps(labels, separators=(",", ":"), ensure_ascii=False)
    return {
        "model_info": compact({"name": limits.model_dir, "provider": limits.provider, "threads": str(limits.num_threads)}),
        "build_info": compact({"version": version, "commit": commit, "build_time": build_time}),
    }


def info_rows(facts: DataFrame, limits: Limits, version: str = "dev", commit: str = "none", build_time: str = "unknown") -> DataFrame:
    """Two rows of value 1 whose labels describe the model and the build."""
    rows = [F.struct(F.lit(name).alias("name"), F.lit(labels).alias("labels"), F.lit(1.0).alias("value")) for name, labels in info_labels(limits, version, commit, build_time).items()]
    return facts.sparkSession.range(1).select(F.inline(F.array(*rows)))


def union_metrics(facts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All metrics as (name, labels, le, value).

    One scan and one exchange of groups: requests are grouped by status and language with their parts of every histogram, then the groups,
    a few hundred, are added up and told as rows. A gauge's last level is the sum of all its changes, null without any.
    """
    limits = limits or Limits()
    none = F.lit(None).cast("string")
    line = lambda name, labels, le, v: F.struct(F.lit(name).alias("name"), labels.cast("string").alias("labels"), F.lit(le).cast("string").alias("le"), v.cast("double").alias("value"))
    parts, lines = {"n": F.count("*")}, []
    for h, (name, buckets) in enumerate(HISTOGRAMS.items()):
        x = histogram_value(name)
        bounds = [*(f"{b:g}" for b in buckets), "+Inf"]
        parts |= {f"h{h}_{i}": c for i, c in enumerate([*bucket_counts(x, buckets), F.count(x), F.sum(x)])}
        lines += [line(f"{name}_bucket", none, le, F.col(f"h{h}_{i}")) for i, le in enumerate(bounds)]
        lines += [line(f"{name}_sum", none, None, F.col(f"h{h}_{len(buckets) + 1}")), line(f"{name}_count", none, None, F.col(f"h{h}_{len(buckets)}"))]
    parts["bytes"] = F.sum(F.when(F.col("status") == 200, F.col("size_bytes")))
    taken = F.col("status") != 429
    start = later(F.col("arrival"), F.col("queue_s"))
    gauges = {"requests_in_progress": [start, later(start, F.col("decode_s") + F.col("inference_s"))], "requests_queued": [F.col("arrival"), start]}
    for name, ends in gauges.items():
        chosen = taken if name == "requests_in_progress" else taken & (F.col("queue_s") > 0)
        known = [chosen & end.isNotNull() for end in ends]
        parts[f"{name}_moves"] = sum((F.count_if(k) for k in known[1:]), F.count_if(known[0]))
        parts[name] = F.count_if(known[0]) - F.count_if(known[1])
    grouped = with_lang(facts).groupBy("status", "lang").agg(*[c.alias(name) for name, c in parts.items()])
    total = F.to_json(F.struct(F.col("status").cast("string").alias("status"), "lang"))
    added = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts if name != "n"]
    one = grouped.agg(F.collect_list(line("requests_total", total, None, F.col("n"))).alias("totals"), *added)
    lines.append(line("audio_bytes_total", none, None, F.col("bytes")))
    lines += [line(name, none, None, F.when(F.col(f"{name}_moves") > 0, F.col(name))) for name in gauges]
    lines += [line(name, F.lit(labels), None, F.lit(1.0)) for name, labels in info_labels(limits).items()]
    return one.select(F.inline(F.concat("totals", F.array(*lines))))
