"""Limits of secrets rest on the decoys of every token, however many a text or a table holds."""

import random
import time
from collections import Counter, defaultdict

import pytest

from auricle.llm import secrets

DOCS = "doc_id long, text string"
PROSE = "the engine reads every table and writes its results where other jobs find them without waiting for anyone to ask".split()


def key(r, n, name="base62"):
    return "".join(r.choice(secrets.ENCODINGS[name]) for _ in range(n))


def accepted_tokens(spark, texts):
    found = secrets.find_secrets(spark, spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return [texts[x.doc_id][s.start : s.stop] for x in found for s in x.all_spans if s.kind == 3]


def test_crowded_text(spark):
    """After 32 keys in prose, the same text has words of random letters, which look like its keys: none of either can be told from an ordinary name."""
    r = random.Random(31)
    plain = [f"{' '.join(r.choices(PROSE, k=200))} {key(r, 80, 'lower')}" for _ in range(secrets.CALIBRATING)]
    odd = [f"{' '.join(key(r, 5, 'lower') for _ in range(200))} {key(r, 80, 'lower')}" for _ in range(secrets.CALIBRATING - 1)]
    assert len(accepted_tokens(spark, plain)) > 20
    assert accepted_tokens(spark, ["\n".join(plain + odd)]) == []


def test_keys_among_names(spark):
    """Names too regular to be keys count as ordinary: a few keys among many of them can be found."""
    r = random.Random(32)
    keys = [key(r, 40) for _ in range(20)]
    names = [f"{''.join(map(str.capitalize, r.sample(PROSE, 9)))[:38]}{r.randrange(10, 99)}" for _ in range(2_000)]
    got = accepted_tokens(spark, [f"{' '.join(r.sample(PROSE, 12))} {t} {' '.join(r.sample(PROSE, 12))}" for t in keys + names])
    assert len(set(got) & set(keys)) >= 10 and not set(got) & set(names)


def test_every_token_counts(spark):
    """Accepted tokens are those by a plain count of every token's decoys, one at a time, over texts of several batches."""
    r = random.Random(33)
    parts = [lambda: key(r, r.randint(16, 70)), lambda: key(r, 40, "base64url"), lambda: key(r, 24, "base32"), lambda: "_".join(r.sample(PROSE, 4)), lambda: "".join(map(str.capitalize, r.sample(PROSE, 5))), lambda: f"/{'/'.join(r.sample(PROSE, 4))}/{r.randrange(2000)}"]
    texts = [" ".join(x for _ in range(r.choice([0, 1, 1, 2])) for x in (*r.sample(PROSE, 5), r.choice(parts)())) for _ in range(1_100)] + [" ".join(key(r, 30) for _ in range(100))]
    tokens, decoys = defaultdict(list), defaultdict(Counter)
    for n, text in enumerate(texts):
        for m in secrets.TOKEN.finditer(text):
            if (result := secrets.tested(m[0])) is None or any(s < m.end() and m.start() < e for s, _, e in secrets.base_spans(text)):
                continue
            body, name, place = result
            cell = name, len(m[0]).bit_length()
            tokens[cell].append((place, n, m[0]))
            decoys[cell].update(secrets.score_bin(d, name) for d in secrets.decoys(*secrets.ordinary_words(text, *m.span(), len(body)), name, len(body)))
    want = []
    for cell, own in tokens.items():
        assert decoys[cell].total() == secrets.DECOYS * len(own)
        p = {b: (sum(n for d, n in decoys[cell].items() if d >= b) + 1) / (decoys[cell].total() + 1) for b in range(secrets.SCORE_BINS)}
        passing = [b for b, n in Counter(t[0] for t in own).items() if p[b] * len(own) <= sum(t[0] >= b for t in own) * secrets.FALSE_DISCOVERY]
        want += [t for b, _, t in own if passing and b >= min(passing)]
    assert len(want) > 100 and sorted(accepted_tokens(spark, texts)) == sorted(want)


def test_scores_together():
    """Strings scored together fall into the bins that they fall into one by one."""
    r = random.Random(34)
    for name, alphabet in secrets.ENCODINGS.items():
        for n in (16, 23, 70, 512):
            bodies = [key(r, n, name) for _ in range(40)] + [alphabet[0] * n, alphabet[-1] * n, (alphabet * n)[:n], ((alphabet[0] + alphabet[-1]) * n)[:n]]
            assert secrets.score_bins(bodies, name).tolist() == [secrets.score_bin(b, name) for b in bodies], (name, n)


@pytest.mark.parametrize("kind", ["names", "keys", "log"])
def test_cost_of_every_token(kind):
    r = random.Random(35)
    make = {
        "names": lambda: "_".join(r.sample(PROSE, 4)),
        "keys": lambda: key(r, 22),
        "log": lambda: f"{r.choice(PROSE)} {r.randrange(10_000)} of {key(r, 22)} {r.choice(PROSE)}",
    }[kind]
    texts = [" ".join(make() for _ in range(40)) for _ in range(100)]
    began = time.process_time()
    seen = [e for _, more in secrets.find_all(texts) for e in more]
    tokens = sum(not e["decoys"] for e in seen)
    assert (time.process_time() - began) / tokens < 500e-6
    assert sum(e["decoys"] for e in seen) == secrets.DECOYS * tokens and len(seen) < tokens + 500
    assert secrets.find_all([]) == []
