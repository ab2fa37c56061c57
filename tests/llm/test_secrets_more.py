"""Secrets beside numbers, identifiers and prefixed keys, found without the operator's own search."""

import random
import re
import time
from collections import defaultdict

import pytest

from auricle.llm import queries, secrets

DOCS = "doc_id long, text string"
PROSE = "the engine reads every table and writes its results where other jobs find them without waiting for anyone to ask".split()


def accepted(spark, tokens, seed=1):
    """How many of the tokens are marked as random, each in prose of its own."""
    r = random.Random(seed)
    around = lambda: " ".join(r.sample(PROSE, 12))
    texts = [f"{around()} {t} {around()}" for t in tokens]
    rows = secrets.find_secrets(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return sum(any(s.kind == 3 for s in x.all_spans) for x in rows)


def test_numbers_are_no_secrets(spark):
    """Card-like numbers, numbers that hold a time, and times to the microsecond."""
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    stamp = lambda: f"2024{r.randrange(1, 13):02}{r.randrange(1, 29):02}{r.randrange(24):02}{r.randrange(60):02}{r.randrange(60):02}"
    tokens = [digits(16) for _ in range(100)] + [f"{1_700_000_000_000 + r.randrange(10**9)}{digits(6)}" for _ in range(100)] + [stamp() + digits(3) for _ in range(100)] + [stamp() + digits(6) for _ in range(100)]
    assert accepted(spark, tokens) == 0


def test_prefixed_keys(spark):
    r = random.Random(3)
    key = lambda n: "".join(r.choice(secrets.ENCODINGS["base62"]) for _ in range(n))
    assert accepted(spark, [f"ghp_{key(36)}" for _ in range(100)]) >= 90
    assert accepted(spark, [f"sk_live_{key(40)}" for _ in range(100)]) >= 90


def test_keys_inside_tokens():
    assert secrets.key_of("sk_live_AbCdEfGh12345678") == "AbCdEfGh12345678" and secrets.key_of("ABCDE-FGHIJ-KLMNO") == "ABCDEFGHIJKLMNO"
    assert secrets.key_of("some_long_name_of_a_thing") == "some_long_name_of_a_thing" and secrets.key_of("ABCDE-FGHI-KLMNO-PQRST") == "ABCDE-FGHI-KLMNO-PQRST"
    assert secrets.key_of("YWJjZGVmZ2hpamtsbW5vcA==") == "YWJjZGVmZ2hpamtsbW5vcA" and secrets.key_of("====") == "===="


def test_driver_tables_hold_base_spans_alone(spark, data_dir):
    """Base spans by plain patterns; nothing is added, least of all numbers."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    want = {}
    for i, text in texts.items():
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        want[i] = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    assert {r.doc_id: r.spans for r in queries.QUERIES["op5_secrets"](spark, data_dir).collect()} == want


@pytest.mark.parametrize("kind", ["names", "keys"])
def test_cost_of_a_token(kind):
    """Text of nothing but identifiers, or of nothing but random ids, costs some tens of microseconds a token."""
    r = random.Random(4)

    def name():
        words = r.sample(PROSE, 4)
        return r.choice(["_".join(words), words[0] + "".join(map(str.capitalize, words[1:])), "-".join(words) + str(r.randrange(99))])

    make = name if kind == "names" else lambda: "".join(r.choice(secrets.ENCODINGS["base62"]) for _ in range(22))
    text = " ".join(make() for _ in range(10_000))
    began = time.process_time()
    _, seen = secrets.find(text)
    assert (time.process_time() - began) / 10_000 < 300e-6
    assert len(seen) < 2 * 10_000


def test_decoys_go_on_with_the_text():
    """Of many like tokens one in CALIBRATING gets decoys, to the end of the text."""
    r = random.Random(5)
    text = " ".join("".join(r.choice(secrets.ENCODINGS["base62"]) for _ in range(40)) for _ in range(2_000))
    per = defaultdict(int)
    for e in secrets.find(text)[1]:
        per[e["start"]] += e["decoys"]
    placed = sorted(s for s, n in per.items() if n)
    assert all(n in (0, secrets.DECOYS) for n in per.values())
    assert placed[-1] > 0.95 * len(text) and len(placed) < 2 * secrets.CALIBRATING + 2_000 // secrets.CALIBRATING
