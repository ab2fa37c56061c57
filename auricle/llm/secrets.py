"""Secret scans: fixed patterns, and tokens that pass a battery of randomness tests."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice
from operator import mul, ne

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch
from auricle.llm.spans import Span, scan, spans_text, with_added

KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, "random")
#: Expected share of ordinary tokens among those accepted, at most, in each encoding and length band.
FALSE_DISCOVERY = 0.05
SCORE_BINS = 50

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# A run that is too short at its start is too short at every later start.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
HEX = re.compile(r"[0-9a-f]{24,}+")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
WORDS = re.compile(r"[A-Za-z]+")
NUMBERS = re.compile(r"[0-9]{1,8}")
#: Words that lead up to a key, each with its separator, and a key written in groups of one length.
PREFIXED = re.compile(r"(?:[a-z]{1,8}[-_]){1,3}([A-Za-z0-9]{16,})")
GROUPS = re.compile(r"([A-Za-z0-9]{4,8})(?:[-_][A-Za-z0-9]{4,8}){2,}")
#: A shorter string, in bits, is no secret however random: numbers of up to 21 digits are cards, accounts, orders and times to the microsecond.
KEY_BITS = 70
#: Where decoys are listed beside their tokens, not summed: tokens of one encoding and length band in one text that all have theirs; of further ones, one in so many.
CALIBRATING = 32
#: Characters of tokens whose decoys are made and scored together.
TOGETHER = 1 << 15
#: Longer tokens are not remembered.
REMEMBERED = 128
#: Decoys of each token, enough for one token alone to be accepted (1 in DECOYS + 1 is below FALSE_DISCOVERY), and
#: the characters on either side of it, over its length, that they are made of.
DECOYS = 20
NEAR = 12
#: Decoys of longer tokens are no longer than this. Shorter ones look more random, so that is on the strict side.
DECOY_LENGTH = 512
#: Stand in where too few words or numbers are near.
PROSE = "the report of this year names every part that was sent to another office before it closed and some which have been found since".split()
COUNTS = "2024 1 10 07 365 2 100 12 1999 64 3 30 2016 8 15 500 4 22 01 1024 6 2012 9 59".split()

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by alphabet, smallest first: the first that holds all of a token is inferred.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower36": DIGITS + LOWER,
    "upper36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "mixed": UPPER + LOWER + DIGITS + "+/-_=",
}
CHARACTERS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def encoding_of(token: str) -> str:
    chars = set(token)
    return next((name for name, known in CHARACTERS.items() if chars <= known), "mixed")


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the Wilson-Hilferty approximation."""
    if df < 1:
        return 1.0
    z = ((max(x, 0) / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@lru_cache(4096)
def bin_shares(name: str, bins: int) -> tuple[list[int], list[float]]:
    """The bin of each symbol of an encoding, by its place, and each bin's share of the symbols."""
    size = len(INDEX[name])
    of = [i * bins // size for i in range(size)]
    return of, [of.count(b) / size for b in range(bins)]


@lru_cache(64)
def cases(name: str) -> tuple[tuple[bytes, float], ...]:
    """Digits, upper and lower case: their characters and their share of an encoding's, if any."""
    size = len(INDEX[name])
    return tuple((g.encode(), n / size) for g in (DIGITS, UPPER, LOWER) if (n := sum(c in g for c in INDEX[name])))


def case_tail(body: bytes, name: str) -> float | None:
    """Tail of the test over digits, upper and lower case; None for encodings of one of them."""
    groups = cases(name)
    if len(groups) < 2:
        return None
    n = len(body)
    return chi2_tail(sum((n - len(body.translate(None, g)) - n * s) ** 2 / (n * s) for g, s in groups), len(groups) - 1)


def randomness(token: str, name: str | None = None) -> tuple[str, float]:
    """Encoding (inferred, unless given), and the combined p-value that the token is a random string in it.

    Chi-squared uniformity over symbols (in as many equal bins as the length bears) and over
    digits, upper and lower case; a runs test about the middle of the alphabet; lag-one
    serial correlation. The four are combined by Fisher's method. They are not independent, so the
    result is a score, not a calibrated probability; ``accepted`` calibrates it by the decoys' scores.
    """
    body = token if name else token.rstrip("=") or token
    name = name or encoding_of(body)
    index = INDEX[name]
    x = [index.get(c, 0) for c in body]
    n, size = len(x), len(index)
    bins = max(2, min(size, n // 4))
    of, share = bin_shares(name, bins)
    seen = [0] * bins
    for v in x:
        seen[of[v]] += 1
    p = [chi2_tail(sum((c - n * s) ** 2 / (n * s) for c, s in zip(seen, share, strict=True)), bins - 1)]
    cased = case_tail(body.encode(), name)
    if cased is not None:
        p.append(cased)
    high = [2 * v >= size for v in x]
    up = sum(high)
    if 0 < up < n:
        mean = 1 + 2 * up * (n - up) / n
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        runs = 1 + sum(map(ne, high, high[1:]))
        p.append(two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    middle = sum(x) / n
    away = [v - middle for v in x]
    spread = sum(map(mul, away, away))
    p.append(two_sided(sum(map(mul, away, away[1:])) / spread * math.sqrt(n)) if spread else 0.0)
    return name, chi2_tail(-2 * sum(math.log(max(v, 1e-300)) for v in p), 2 * len(p))


@lru_cache(8)
def hopeless(tests: int) -> float:
    """A single test's tail below which the combined score is in the lowest bin, whatever the others say."""
    low, high = 1e-12, 1.0
    while high / low > 1.01:
        middle = math.sqrt(low * high)
        low, high = (middle, high) if chi2_tail(-2 * math.log(middle), 2 * tests) * SCORE_BINS < 1 else (low, middle)
    return low


def score_bin(body: str, name: str) -> int:
    """Bin of the token's score; names with too little of a case, most of a text's long tokens, take the quick way to the lowest one."""
    cased = case_tail(body.encode(), name)
    if cased is not None and cased < hopeless(4):
        return 0
    return bin_of(randomness(body, name)[1])


@lru_cache(256)
def score_tables(name: str) -> tuple[np.ndarray, list[tuple[np.ndarray, float]]]:
    """By character code: the place in an encoding; and, for each of its cases, whether it is of that case, with the case's share."""
    place = np.zeros(128, np.int64)
    for c, i in INDEX[name].items():
        place[ord(c)] = i
    return place, [(np.isin(np.arange(128), list(g)), share) for g, share in cases(name)]


ERFC = np.frompyfunc(math.erfc, 1, 1)


def chi2_tails(x: np.ndarray, df: int) -> np.ndarray:
    """``chi2_tail`` of many."""
    return 0.5 * ERFC((np.cbrt(x / df) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)) / math.sqrt(2)).astype(float)


def score_bins(bodies: list[str], name: str) -> np.ndarray:
    """``score_bin`` of many strings of one length in the characters of one encoding."""
    n, m, size = len(bodies[0]), len(bodies), len(INDEX[name])
    place, case = score_tables(name)
    codes = np.frombuffer("".join(bodies).encode(), np.uint8).reshape(m, n)
    x = place[codes]
    bins = max(2, min(size, n // 4))
    of, share = map(np.array, bin_shares(name, bins))
    expected = n * share
    seen = np.bincount((of[x] + np.arange(m)[:, None] * bins).ravel(), minlength=m * bins).reshape(m, bins)
    p = [chi2_tails(((seen - expected) ** 2 / expected).sum(1), bins - 1)]
    if len(case) > 1:
        p.append(chi2_tails(sum((is_case[codes].sum(1) - n * s) ** 2 / (n * s) for is_case, s in case), len(case) - 1))
    high = 2 * x >= size
    up = high.sum(1)
    mean = 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / max(1, n - 1)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    away_runs = np.divide(np.abs(runs - mean), np.sqrt(np.maximum(var, 0)), out=np.zeros(m), where=var > 0)
    p.append(np.where((up > 0) & (up < n), ERFC(away_runs / math.sqrt(2)).astype(float), 2.0 ** (1 - n)))
    away = x - x.mean(1, keepdims=True)
    spread = (away * away).sum(1)
    lag = np.divide(np.abs((away[:, 1:] * away[:, :-1]).sum(1)), spread, out=np.full(m, np.inf), where=spread > 0)
    p.append(ERFC(lag * math.sqrt(n) / math.sqrt(2)).astype(float))
    score = chi2_tails(-2 * np.log(np.maximum(p, 1e-300)).sum(0), 2 * len(p))
    return np.minimum((score * SCORE_BINS).astype(int), SCORE_BINS - 1)


def key_of(token: str) -> str:
    """What of a token would be random if it is a key: without padding, words that lead up to it, or separators between groups of one length."""
    body = token.rstrip("=") or token
    if "-" not in body and "_" not in body:
        return body
    if m := PREFIXED.fullmatch(body):
        return m[1]
    if (m := GROUPS.fullmatch(body)) and len({len(g) for g in re.split("[-_]", body)}) == 1:
        return re.sub("[-_]", "", body)
    return body


def ordinary_words(text: str, start: int, stop: int, length: int) -> tuple[list[str], list[str]]:
    """Words and numbers near a place in a text, without those of other long tokens; then ordinary ones."""
    reach = NEAR * length
    before, after = text[max(0, start - reach) : start], text[stop : stop + reach]
    # what the window cuts through may be the rest of a long token
    before = before if start <= reach else before.partition(" ")[2]
    after = after if stop + reach >= len(text) else after.rpartition(" ")[0]
    near = TOKEN.sub(" ", f"{before} {after}")
    words, numbers = WORDS.findall(near), NUMBERS.findall(near)
    return (words if sum(map(len, words)) >= 2 * length else words + PROSE), numbers + COUNTS


@lru_cache(64)
def unknown(name: str) -> dict[int, None] | None:
    """What of letters and digits an encoding lacks, to be dropped by ``str.translate``; None if it has all."""
    return str.maketrans("", "", "".join(c for c in DIGITS + LOWER + UPPER if c not in INDEX[name])) or None


def written(parts: list[str], as_written: Callable[[str], str], drop: dict[int, None] | None) -> list[str]:
    text = as_written("\n".join(parts))
    return (text.translate(drop) if drop else text).split("\n")


def decoys(words: list[str], numbers: list[str], name: str, length: int, n: int = DECOYS) -> Iterator[str]:
    """Ordinary strings of an encoding and length: names run together of words and numbers, those near a token.

    They are the most random-looking of ordinary names: words are capitalised where the encoding has
    both cases, a number follows every few words where it has digits, and a symbol stands between
    words where it has symbols.
    """
    index = INDEX[name]
    symbols = [c for c in "-/_+=" if c in index]
    every = 0 if "2" not in index else 1 if "g" not in index and "G" not in index else 3 if "A" in index and "a" in index else 2
    words = written(words, str.title if "A" in index and "a" in index else str.lower if "a" in index else str.upper, unknown(name))
    numbers = written(numbers, str, unknown(name))
    w, v = len(words), len(numbers)
    for k in range(n):
        out, size, i = [], 0, k * max(1, w // n)
        for at in range(2 * length + w):
            part = words[(i + at) % w]
            if every and at % every == every - 1:
                part += numbers[(i + at // every) % v]
            if symbols:
                part += symbols[(k + at // 4) % len(symbols)]
            out.append(part)
            size += len(part)
            if size >= length:
                yield "".join(out)[:length]
                break


def bin_of(score: float) -> int:
    return min(int(score * SCORE_BINS), SCORE_BINS - 1)


@lru_cache(1 << 16)
def tested(token: str) -> tuple[str, str, int] | None:
    """(key, its encoding, bin) of a token; None if it is too short to be one. Names recur, so many are remembered."""
    body = key_of(token)
    name = encoding_of(body)
    return None if len(body) * math.log2(len(INDEX[name])) < KEY_BITS else (body, name, score_bin(body, name))


class Sums:
    """Test results of the decoys of many tokens, summed by encoding, length band and bin.

    Tokens with the same words and numbers nearby have the same decoys, which are made once; those of one encoding and length are scored together.
    """

    def __init__(self) -> None:
        self.waiting, self.characters = Counter(), 0
        self.sums, self.spans = Counter(), {}

    def add(self, text: str, start: int, stop: int, name: str, length: int) -> None:
        band = (stop - start).bit_length()
        self.spans[name, band] = start, stop
        words, numbers = ordinary_words(text, start, stop, length)
        key = name, length, band, tuple(words), tuple(numbers)
        self.characters += 0 if key in self.waiting else length
        self.waiting[key] += 1
        if self.characters >= TOGETHER:
            self.score()

    def score(self) -> None:
        alike = defaultdict(list)
        for (name, length, band, words, numbers), n in self.waiting.items():
            alike[name, length].append((band, n, list(decoys(words, numbers, name, length))))
        for (name, _), lots in alike.items():
            bodies = [d for *_, made in lots for d in made]
            places = iter(score_bins(bodies, name).tolist() if bodies else ())
            for band, n, made in lots:
                for place in islice(places, len(made)):
                    self.sums[name, band, place] += n
        self.waiting.clear()
        self.characters = 0

    def records(self) -> list[dict]:
        """The sums, each beside the last token of its encoding and band."""
        self.score()
        return [{"start": self.spans[name, band][0], "stop": self.spans[name, band][1], "encoding": name, "bin": place, "decoys": n} for (name, band, place), n in self.sums.items()]


def find(text: str, sums: Sums | None = None) -> tuple[list[Span], list[dict]]:
    """Base spans; and tokens beside them with their test results, and those of decoys in their encodings.

    With ``sums``, those of every token's decoys are added to it, as limits need them. Without, they are
    listed beside their tokens, for a look at one text: of many like tokens, for one in CALIBRATING, evenly.
    """
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    seen, k, reach, many = [], 0, 0, Counter()
    for m in TOKEN.finditer(text):
        start, stop = m.span()
        while k < len(taken) and taken[k][0] < stop:
            reach = max(reach, taken[k][1])
            k += 1
        if reach > start:
            continue
        result = tested(m[0]) if stop - start <= REMEMBERED else tested.__wrapped__(m[0])
        if result is None:
            continue
        body, name, place = result
        seen.append({"start": start, "stop": stop, "encoding": name, "bin": place, "decoys": 0})
        length = min(len(body), DECOY_LENGTH)
        if sums is not None:
            sums.add(text, start, stop, name, length)
            continue
        cell = name, (stop - start).bit_length()
        many[cell] += 1
        if many[cell] <= CALIBRATING or many[cell] % CALIBRATING == 0:
            made = list(decoys(*ordinary_words(text, start, stop, length), name, length))
            tests = Counter(score_bins(made, name).tolist() if made else ())
            seen += [{"start": start, "stop": stop, "encoding": name, "bin": b, "decoys": n} for b, n in tests.items()]
    return base, seen


def find_all(texts: list[str]) -> list[tuple[list[Span], list[dict]]]:
    """Base spans and tokens of each text; what the decoys of all their tokens score comes with the last, in sums."""
    sums = Sums()
    found = [find(text, sums) for text in texts]
    if found:
        found[-1][1].extend(sums.records())
    return found


def accepted(seen: DataFrame) -> DataFrame:
    """Tokens accepted at the wanted false-discovery rate, per encoding and length band (powers of two).

    The share of a cell's decoys at or above a score, one added to both, is the p-value of an ordinary
    token; the lowest score that passes Benjamini and Hochberg's bound at FALSE_DISCOVERY is the cell's
    limit. A cell with one token can pass, as it has DECOYS of them. The limits are at most one per
    encoding and band, a few hundred rows.
    """
    band = F.floor(F.log2((F.col("stop") - F.col("start")).cast("double"))).cast("int")
    rows = seen.withColumn("band", band)
    counts = rows.groupBy("encoding", "band", "bin").agg(F.sum(F.col("decoys").cast("long")).alias("decoys"), F.sum((F.col("decoys") == 0).cast("long")).alias("tokens"))
    cell = Window.partitionBy("encoding", "band")
    above = cell.orderBy(F.desc("bin"))
    sums = counts.select("encoding", "band", "bin", *[F.sum(c).over(w).alias(f"{c}_{name}") for c in ("decoys", "tokens") for name, w in (("above", above), ("all", cell))])
    passes = (F.col("decoys_above") + 1) * F.col("tokens_all") <= F.col("tokens_above") * FALSE_DISCOVERY * (F.col("decoys_all") + 1)
    limits = sums.where(passes).groupBy("encoding", "band").agg(F.min("bin").alias("limit"))
    return rows.where("decoys = 0").join(F.broadcast(limits), ["encoding", "band"]).where("bin >= limit")


def find_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, base, all_spans.

    Null and empty texts give no spans; texts and tokens of any length are read whole; ids may be null or
    repeated; an empty table gives no rows.
    """
    found = Scratch(spark, "secrets").save(scan(docs, KINDS, find_all, "start int, stop int, encoding string, bin int, decoys int"), "found")
    seen = found.select("row", F.explode("extra").alias("e")).select("row", "e.*")
    return with_added(found, accepted(seen), len(KINDS))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans_text("all_spans", ALL_KINDS).alias("spans"))
