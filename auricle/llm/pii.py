"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find.

What the fixed patterns find are the seeds. Each seed and each candidate (a string that could be of a
kind, but that the fixed patterns don't take) gives lexical patterns: the words and signs around it, in several
widths on either side. Patterns and instances of a kind form a graph, which Spark scores in rounds: a
pattern's score is its share of confirmed instances, patterns above the threshold confirm what stands in them, and so on
until nothing new is confirmed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.llm.common import Scratch
from auricle.llm.spans import Span, redact, scan, spans_text, with_added

KINDS = ("email", "ip", "card", "phone")
#: Spans that the bootstrapped patterns add.
ALL_KINDS = (*KINDS, "found")
#: A pattern is trusted if its confirmed instances are at least CONFIRMED in OF of all its instances and one
#: more that is not confirmed: so four of four, eight of nine.
CONFIRMED, OF = 4, 5
#: Occurrences of a frequent pattern are dealt over so many keys.
SALTS = 8

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run's first digit decides for the whole run, so runs are entered at their start only.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Strings that could be of a kind; what they may not be follows.
WIDE_EMAIL = re.compile(r"(?<![^\s<>\"'()\[\],;:])[^\s<>\"'()\[\],;:@]++(?:@[\w-]++(?:\.[\w-]++)*+|(?: ?[\[(]at[\])] ?| at )[\w-]++(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]++)++)")
WIDE_IP = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])|(?<![\w.])[0-9]++(?:\.[0-9]++){3}(?![\w.])")
#: Digits in one group or several, with single signs (or a sign and a blank) between groups.
NUMBER = re.compile(r"(?<![\w.,:/$€£%-])[+(]?[0-9]++(?:(?:[ .()/-]|\) |\)-| \(|[.-] )[0-9]++)*+(?![\w%$€£]|[.,:/-][0-9])")
DIGIT_GROUP = re.compile(r"[0-9]++")
DATE = re.compile(r"[0-9]{4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:[0-9]{4}|[0-9]{2})")
RIGHT = re.compile(r"([^\w]{1,3})([^\W\d_]+)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from the @ outwards, so in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else max(free, at + 1)
        if domain:
            out.append((start, 0, free))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def number_list(number: str) -> bool:
    """Whether a number reads as a list of numbers: years, even steps (of its digits, if it has no groups), or single digits behind its first group.

    Context alone would confirm any number that follows "call"; a phone or card number's groups have two digits or more and
    no order among them.
    """
    groups = DIGIT_GROUP.findall(number)
    values = [int(g) for g in (groups[0] if len(groups) == 1 else groups)]
    even = len(values) > 2 and len({b - a for a, b in zip(values, values[1:], strict=False)}) == 1
    if len(groups) < 3:
        return even
    return even or any(len(g) < 2 for g in groups[1:]) or all(len(g) == 4 and g[:2] in ("19", "20") for g in groups)


def wide_kinds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings that could be of a kind by their form: the candidates.

    Phone numbers have 6 to 15 digits, cards 12 to 19; neither reads as a list of numbers.
    """
    out = []
    if "@" in text or " at " in text or "at]" in text or "at)" in text:
        out += [(m.start(), 0, m.end()) for m in WIDE_EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in WIDE_IP.finditer(text) if m[0].count(":") != 2 or "::" in m[0]]
    for m in NUMBER.finditer(text):
        digits = sum("0" <= c <= "9" for c in m[0])
        if number_list(m[0]):
            continue
        if 6 <= digits <= 15 and m[0].count(".") != 1 and not DATE.fullmatch(m[0]):
            out.append((m.start(), 3, m.end()))
        if 12 <= digits <= 19 and "." not in m[0]:
            out.append((m.start(), 2, m.end()))
    return out


def word_before(text: str, end: int) -> tuple[int, int] | None:
    """(start, end) of the word before a position, one to three signs away."""
    stop = end
    while stop > max(0, end - 3) and not (text[stop - 1].isalnum() or text[stop - 1] == "_"):
        stop -= 1
    start = stop
    while start > 0 and text[start - 1].isalpha():
        start -= 1
    return (start, stop) if start < stop < end else None


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence: one word before, two before, one after, one on either side; words in lower case, with the signs at the slot."""
    left, right = word_before(text, start), RIGHT.match(text, end)
    out, after = [], f"{right[1]}{right[2].lower()}" if right else ""
    if left:
        one = text[left[0] : start].lower()
        out.append(f"{one}_")
        if (two := word_before(text, left[0])) is not None:
            out.append(f"{text[two[0] : start].lower()}_")
        if right:
            out.append(f"{one}_{after}")
    return [*out, f"_{after}"] if right else out


def find(text: str) -> tuple[list[Span], list[dict]]:
    """Base spans, and every occurrence (kind, patterns, instance) of a seed or of a candidate beside them."""
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    seen = [(s, e, k, True) for s, k, e in base]
    for start, kind, end in wide_kinds(text):
        k = bisect_right(taken, (start, len(text)))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
            seen.append((start, end, kind, False))
    return base, [
        {"start": s, "stop": e, "pattern": f"{k}{p}", "instance": " ".join(text[s:e].lower().split()), "seed": seed} for s, e, k, seed in seen for p in patterns(text, s, e)
    ]


def pattern_scores(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(pattern, confirmed, instances) of distinct (pattern, instance) edges, given the confirmed (pattern, instance) ones.

    Both are counts by pattern with partial sums, so frequent patterns stay spread.
    """
    hits = confirmed.groupBy("pattern").agg(F.count("*").alias("confirmed"))
    return edges.groupBy("pattern").agg(F.count("*").alias("instances")).join(hits, "pattern")


def of_patterns(occurrences: DataFrame, few: DataFrame, spread: str) -> DataFrame:
    """``occurrences`` of the patterns in ``few``; a frequent pattern's are dealt over SALTS keys by the column ``spread``.

    ``few`` is hashed where it lies: as Spark's size of it counts one of its SALTS rows a pattern, it could be broadcast too large.
    """
    salted = occurrences.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    keys = few.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(keys.hint("shuffle_hash"), ["pattern", "salt"], "left_semi").drop("salt")


def trusted_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) to trust, from the bipartite graph of distinct (pattern, instance, seed) edges.

    A pattern starts with its kind, and instances are told apart by kind. Confirmed are at first the seeds.
    In each round every pattern is scored by its share of confirmed instances, smoothed by one unconfirmed
    one; instances of trusted patterns are confirmed in the next. Confirmed sets only
    grow, so rounds end, when none is added. Patterns that can't be trusted, having too few instances,
    are left out at once.
    """
    enough = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") * OF >= (F.col("n") + 1) * CONFIRMED)
    graph = of_patterns(edges, enough, "instance").withColumn("instance", F.concat(F.substring("pattern", 1, 1), "instance"))
    graph = scratch.save(graph.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    known = scratch.save(graph.where("seed").select("instance").distinct(), "known0")
    size, step = known.count(), 0
    while True:
        scores = pattern_scores(graph, graph.join(known, "instance", "left_semi"))
        now = scores.where(F.col("confirmed") * OF >= (F.col("instances") + 1) * CONFIRMED)
        trusted = scratch.save(now.select("pattern", (F.col("confirmed") / (F.col("instances") + 1)).alias("score")), f"trusted{step}")
        step += 1
        known = scratch.save(known.unionByName(of_patterns(graph, trusted, "instance").select("instance")).distinct(), f"known{step}")
        before, size = size, known.count()
        if size == before:
            return trusted


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_sha256, base, all_spans.

    Null and empty texts give no spans; texts of any length are read whole; ids may be null or repeated; an
    empty table gives no rows. Texts are scanned once; the patterns work on what was found.
    """
    scratch = Scratch(spark, "pii")
    found = scratch.save(scan(docs, KINDS, partial(map, find), "start int, stop int, pattern string, instance string, seed boolean"), "found")
    seen = found.select("row", F.explode("extra").alias("e")).select("row", "e.*")
    trusted = trusted_patterns(seen.select("pattern", "instance", "seed").distinct(), scratch)
    added = of_patterns(seen.where("not seed"), trusted, "row").select("row", "start", "stop").distinct()
    return with_added(found, added, len(KINDS))


def redact_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with every span replaced by its kind in brackets (see ``spans.redact``)."""
    return redact(docs, find_personal_data(spark, docs.select("doc_id", "text")), ALL_KINDS)


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_personal_data(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans_text("all_spans", ALL_KINDS).alias("spans"))
