"""Metrics in one pass: results against plain Python, scans in the executed plans."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from auricle.operators import metrics
from auricle.plans import views
from auricle.schemas import REQUEST_FACTS, Limits

START = dt.datetime(2024, 3, 1)


def crowded_facts(spark, n=400, seed=1):
    """A third of all requests arrive at one instant; others meet at few instants, some weeks apart; some fields are null."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = START if i % 3 == 0 else START + dt.timedelta(days=r.choice([0, 0, 1, 9]), seconds=r.randrange(20) * 0.25)
        queue = r.choice([0.0, 0.0, 0.25, 1.0])
        rows.append((f"r{i}", at, queue, r.choice([0.25, 2.0, None]), r.choice([0.5, 100_000.0]), 3.0, 10, 5000, r.choice(["en", "de", None]), "", r.choice([200, 200, 200, 400, 408, 413, 429])))
    return spark.createDataFrame(rows, REQUEST_FACTS)


def plain_report(rows, window_s=86_400):
    """Requests, rejections, timeouts and peaks per window, by walking all instants."""
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000 + 0.5)
    step, moves, counts = window_s * 1_000_000, {}, {}
    for x in rows:
        window = us(x.arrival) // step * step
        c = counts.setdefault(window, [0, 0, 0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + (x.status == 429), c[2] + (x.status == 408)
        if x.status == 429:
            continue
        start = us(x.arrival) + round(x.queue_s * 1_000_000)
        changes = [(us(x.arrival), 0, 1), (start, 0, -1)] if x.queue_s > 0 else []
        changes.append((start, 1, 0))
        if x.decode_s is not None:
            changes.append((start + round((x.decode_s + x.inference_s) * 1_000_000), -1, 0))
        for at, busy, waiting in changes:
            b, w = moves.get(at, (0, 0))
            moves[at] = b + busy, w + waiting
    first = min(min(moves) // step * step, min(counts))
    last = max(max(moves) // step * step, max(counts))
    found, busy, waiting = [], 0, 0
    for window in range(first, last + 1, step):
        tops = [busy, waiting]
        for at in sorted(a for a in moves if window <= a < window + step):
            busy, waiting = busy + moves[at][0], waiting + moves[at][1]
            tops = [max(tops[0], busy), max(tops[1], waiting)]
        found.append((window, *counts.get(window, (0, 0, 0)), *tops))
    return found


@pytest.mark.parametrize("window", ["1 day", "2 seconds", "7 hours"])
def test_overload_report(spark, window):
    facts = crowded_facts(spark).where("arrival < '2024-03-03'") if window == "2 seconds" else crowded_facts(spark)
    facts = facts.where("inference_s < 10") if window == "2 seconds" else facts
    seconds = {"1 day": 86_400, "2 seconds": 2, "7 hours": 25_200}[window]
    got = metrics.overload_report(facts, Limits(max_concurrent=60, max_queue=40), window)
    assert got.columns == ["window_start", "requests", "rejected", "timed_out", "peak_in_progress", "peak_queued", "over_limit"]
    rows = got.select(F.unix_micros("window_start"), *got.columns[1:]).collect()
    want = [(*w, w[4] > 60 or w[5] > 40) for w in plain_report(facts.collect(), seconds)]
    assert sorted(map(tuple, rows)) == want


def executed_scans(df):
    """Scans that ran, and stages read again."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text
    text = text.split("== Initial Plan ==")[0]
    return text.count("Scan parquet"), text.count("ReusedExchange")


def test_one_scan(spark, data_dir):
    facts = views.facts(spark, data_dir)
    for df in (metrics.overload_report(facts), metrics.union_metrics(facts)):
        assert executed_scans(df) == (1, 0)


def test_union_without_rows(spark):
    facts = crowded_facts(spark)
    rows = {(r.name, r.labels, r.le): r.value for r in metrics.union_metrics(facts.limit(0)).collect()}
    assert len(rows) == 4 * 11 + 1 + 2 + 2
    assert rows["requests_in_progress", None, None] is None and rows["requests_queued", None, None] is None
    assert rows["audio_bytes_total", None, None] == 0 and rows["request_duration_seconds_bucket", None, "+Inf"] == 0
    assert json.loads(next(k[1] for k in rows if k[0] == "model_info")) == {"name": "models", "provider": "cpu", "threads": "4"}


def test_union_agrees_with_its_parts(spark):
    facts = crowded_facts(spark)
    rows = {(r.name, r.labels, r.le): r.value for r in metrics.union_metrics(facts).collect()}
    for part in (metrics.request_duration, metrics.decode_duration, metrics.inference_duration, metrics.audio_duration):
        for r in part(facts).collect():
            assert rows[r.name, None, r.le] == pytest.approx(r.value)
    for r in metrics.requests_total(facts).collect():
        assert rows["requests_total", json.dumps({"status": str(r.status), "lang": r.lang}, separators=(",", ":")), None] == r.value
    for name, gauge in (("requests_in_progress", metrics.in_progress_over_time), ("requests_queued", metrics.queued_over_time)):
        assert rows[name, None, None] == gauge(facts).where("at is not null").orderBy(F.desc("at")).first().level
    assert rows["audio_bytes_total", None, None] == metrics.audio_bytes_total(facts).first().value
