"""Substring dedup: repeats of at least ``min_words`` words, by winnowed anchors that are extended both ways."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, column_bytes, hot_keys, map_batches, spread_join

MIN_WORDS = 13
ANCHOR_WORDS = 5
#: Word hashes kept by a Python worker before it starts afresh.
MEMO = 300_000
#: Documents that a Python worker unpacks at a time.
SLICE = 250
#: Occurrences of a window in distinct passages are dealt over so many keys.
WINDOW_SALTS = 8
_memo: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = []
    for w in words:
        h = _memo.get(w)
        if h is None:
            if len(_memo) >= MEMO:
                _memo.clear()
            h = _memo[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words."""
    n = len(h) - k + 1
    g = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : n + i]
    return _mixed(g)


def anchors(h: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors of a document: (anchor hash, first window, windows) of each.

    Every window of ``min_words`` words picks the smallest (rightmost, if tied) hash of its
    ``k``-word grams, which depends on the window's words alone: equal windows pick equal
    anchors at equal places. Consecutive windows with the same pick are one occurrence of the anchor.
    """
    grams, width = gram_hashes(h, k), min_words - k + 1
    n = len(grams) - width + 1
    low, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        later = grams[i : n + i]
        take = later <= low
        low = np.where(take, later, low)
        at = np.where(take, np.arange(i, n + i), at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return low[first], first, np.diff(np.append(first, n))


def _anchor_rows(docs: DataFrame, min_words: int, k: int, bits: int) -> DataFrame:
    """(anchor, doc_id, text_hash, first, count) of documents (doc_id, text_hash, text)."""
    mask = np.uint64((1 << bits) - 1)

    def make():
        def on_batch(batch: pa.RecordBatch):
            ids, hashes = batch.column(0), batch.column(1)
            parts: list[tuple] = []
            size = 0

            def packed():
                at = pa.array(np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]))
                a, first, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 4))
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), ids.take(at), hashes.take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "doc_id", "text_hash", "first", "count"])

            for i, text in enumerate(column_bytes(batch.column(2))):
                words = (text or b"").split()
                if len(words) >= min_words:
                    parts.append((i, *anchors(word_hashes(words) & mask, min_words, k)))
                    size += len(parts[-1][1])
                if size > 50_000:
                    yield packed()
                    parts, size = [], 0
            if parts:
                yield packed()

        return on_batch

    return map_batches(docs, make, "anchor long, doc_id long, text_hash long, first int, count int")


def _passage_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_hash, text, seeds array<struct<first,count,anchor>>) to one row a seed, extended both ways on the words."""

    def make():
        def on_batch(batch: pa.RecordBatch):
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                seeds = piece.column(3)
                ends = np.cumsum(np.diff(seeds.offsets.to_numpy()))
                flat = seeds.flatten()
                first, count = flat.field(0), flat.field(1)
                f, stop = first.to_numpy(), (first.to_numpy() + count.to_numpy() + min_words - 1).tolist()
                out, at = [], 0
                for text, end in zip(column_bytes(piece.column(2)), ends.tolist(), strict=True):
                    words = text.split()
                    out += [b" ".join(words[a:b]) for a, b in zip(f[at:end].tolist(), stop[at:end], strict=True)]
                    at = end
                owner = pa.array(np.repeat(np.arange(piece.num_rows), np.diff(np.concatenate([[0], ends]))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), piece.column(0).take(owner), piece.column(1).take(owner), first, count, flat.field(2)], ["words", "doc_id", "text_hash", "first", "count", "anchor"])

        return on_batch

    return map_batches(docs, make, "words string, doc_id long, text_hash long, first int, count int, anchor long")


def passages(docs: DataFrame, min_words: int, k: int, bits: int, scratch: Scratch) -> DataFrame:
    """(words, code, doc_id, text_hash, first, count, anchor): occurrences of anchors that documents share, extended both ways.

    Documents are joined on their winnowed anchors: an anchor that occurs once is dropped, as every window of a repeat
    picks an anchor that occurs again. An occurrence is extended over all words of the windows that pick it.
    ``code`` is a hash of the words.
    """
    seen = scratch.save(_anchor_rows(docs.select("doc_id", "text_hash", "text"), min_words, k, bits), "anchors")
    common = scratch.save(seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "common")
    shared = spread_join(seen, common.select("anchor"), "anchor", hot_keys(common, "anchor"), ["doc_id", "text_hash", "first"], "left_semi")
    lists = shared.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "count", "anchor")).alias("seeds"))
    lists = scratch.save(lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "seeds"), "seeds")
    scratch.drop("anchors", "common")
    texts = docs.join(lists, docs["doc_id"].eqNullSafe(lists["_id"]) & (docs["text_hash"] == lists["_hash"])).select("doc_id", "text_hash", "text", "seeds")
    code = F.xxhash64("words").bitwiseAND(F.lit((1 << min(bits, 63)) - 1))
    # a passage's words are mostly its neighbour's too, which zstd makes use of
    found = scratch.save(_passage_rows(texts, min_words).withColumn("code", code), "passages", "zstd")
    scratch.drop("seeds")
    return found


def partial_repeats(firsts: DataFrame, min_words: int, bits: int, scratch: Scratch) -> DataFrame:
    """(id, mask): windows of each distinct passage that another passage of smaller document id holds too, as bits by offset.

    This finds where a repeat starts or ends inside a passage. Equal windows pick equal anchors, so only passages
    of anchors with several are looked at. Windows whose hash occurs once are dropped; the others are grouped by their words.
    """
    kinds = scratch.save(firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "kinds")
    firsts = scratch.save(spread_join(firsts, kinds.select("anchor"), "anchor", hot_keys(kinds, "anchor"), ["id"], "left_semi"), "mixed", "zstd")
    split = firsts.select("id", "lowest", F.split("words", " ").alias("list"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("offset"))
    text = F.array_join(F.slice("list", F.col("offset") + 1, min_words), " ")
    hashed = scratch.save(split.select("id", "offset", F.xxhash64(text).bitwiseAND(F.lit((1 << min(bits, 63)) - 1)).alias("hash")), "hashes")
    counts = scratch.save(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    again = spread_join(hashed, counts.select("hash"), "hash", hot_keys(counts, "hash"), ["id", "offset"], "left_semi").groupBy("id").agg(F.collect_set("offset").alias("offsets"))
    listed = firsts.select("id", "lowest", F.split("words", " ").alias("list")).join(again, "id").select("id", "lowest", "list", F.explode("offsets").alias("offset"))
    windows = scratch.save(listed.select("id", "lowest", "offset", text.alias("window")), "windows")
    scratch.drop("hashes", "repeated")
    lows = windows.groupBy("window").agg(F.min("lowest").alias("low"), F.count("*").alias("n")).where("n > 1 and low is not null").select("window", "low")
    salts = F.explode(F.sequence(F.lit(0), F.lit(WINDOW_SALTS - 1))).alias("salt")
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(WINDOW_SALTS)).cast("int"))
    hit = salted.join(lows.select("window", "low", salts), ["window", "salt"]).where("lowest is null or low < lowest")
    masks = scratch.save(hit.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")), "masks")
    scratch.drop("windows", "kinds", "mixed")
    return masks


def repeated_windows(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS, bits: int = 64) -> DataFrame:
    """(doc_id, text_hash, windows): per document the windows that also start in a document of smaller id, by passage.

    ``docs`` has doc_id, text, text_hash. Passages (see ``passages``) are grouped by their words, with partial
    aggregation; documents other than the one of smallest id repeat the whole passage, and of that
    one single windows are compared with those of all other passages (see ``partial_repeats``). Hashes of ``bits`` bits
    only deal rows out and drop what occurs once: passages and windows are equal if their words are. No pairs of
    documents are formed at any step, however common a passage is.
    """
    scratch = Scratch(spark, "substring")
    found = passages(docs, min_words, k, bits, scratch)
    # a passage whose documents all lack an id has no lowest one
    grouped = found.groupBy("words", "code", "anchor").agg(F.min("doc_id").alias("lowest"), F.min("count").alias("count"), F.count("*").alias("n"))
    firsts = scratch.save(grouped.withColumn("id", F.monotonically_increasing_id()), "firsts", "zstd")
    masks = partial_repeats(firsts, min_words, bits, scratch)
    decided = scratch.save(firsts.select("id", "code", "lowest", "n").join(masks, "id", "left"), "decided")
    by_code = scratch.save(decided.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "codes")
    # what occurs once, and has no window that recurs, goes nowhere
    own = decided.where("n > 1 or mask is not null").join(by_code.where("kinds = 1").select("code"), "code", "left_semi").select("code", "lowest", "mask")
    gone = spread_join(found.drop("words", "anchor"), own, "code", hot_keys(by_code.where("kinds = 1"), "code"), ["doc_id", "text_hash", "first"])
    several = by_code.where("kinds > 1").select("code")
    if not several.isEmpty():  # passages that share a code are told apart by their words
        told = firsts.join(several, "code", "left_semi").select("id", "words", "code").join(decided.select("id", "lowest", "mask"), "id").drop("id")
        gone = gone.unionByName(found.drop("anchor").join(several, "code", "left_semi").join(told, ["code", "words"]).drop("words"))
    every = F.expr("shiftleft(1L, `count`) - 1")
    mask = F.when(F.col("lowest").isNotNull() & (F.col("doc_id").isNull() | (F.col("lowest") < F.col("doc_id"))), every).otherwise(F.col("mask"))
    gone = gone.select("doc_id", "text_hash", "first", mask.alias("mask")).where("mask <> 0")
    out = scratch.save(gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "mask")).alias("windows")), "gone")
    scratch.drop("passages", "firsts", "masks", "decided", "codes")
    return out


def covered_words(windows: list[dict], n: int, min_words: int) -> np.ndarray:
    """Which of a text's ``n`` words lie in its maximal repeats, the unions of its repeated windows; bit i of a mask stands for the window ``first + i``."""
    edge = np.zeros(n + 1, np.int64)
    for w in windows:
        mask, at = w["mask"], w["first"]
        while mask:
            if mask & 1:
                edge[at] += 1
                edge[at + min_words] -= 1
            mask >>= 1
            at += 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS, bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one space).

    Removed is each word covered by a window of ``min_words`` words that also starts in a
    document of smaller id. Null texts have no words; a null id is larger than any other, and
    documents without id don't repeat each other; rows repeated in full don't either, having one id. An empty table gives no rows; other columns are not looked at.
    """
    if not k <= min_words <= k + 62:
        raise ValueError("min_words must be from k to k + 62")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    gone = repeated_windows(spark, hashed, min_words, k, bits).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "windows")
    joined = hashed.join(gone, hashed["doc_id"].eqNullSafe(gone["_id"]) & (hashed["text_hash"] == gone["_hash"]), "left")

    def make():
        def on_batch(batch: pa.RecordBatch):
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                total, removed, kept = [], [], []
                for text, windows in zip(column_bytes(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    words = (text or b"").split()
                    total.append(len(words))
                    if windows:
                        covered = covered_words(windows, len(words), min_words)
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

        return on_batch

    return map_batches(joined.select("doc_id", "text", "windows"), make, "doc_id long, n_words long, n_removed long, kept string")


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, n_words, n_removed, kept_sha256."""
    cut = dedup_substrings(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
