"""Ranked lexical search by dense blocked multiplication.

Items are taken in blocks. One pass over the documents keeps, of each, its length and how often it has each term of the block; document
frequencies are counted from that table. A second pass multiplies tiles: item rows by their own vocabulary, and that vocabulary by documents, each entry a term's impact,
through BLAS in double precision. No partial sum passes 2^53, so each is exact, and tiles add up in 64-bit integers.
Each task keeps the best documents of each item; ties at its floor stay until document ids decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, column_bytes, map_batches

TOP = 20
#: Text of the items that one pass over the documents answers, in bytes; a longer item is a block of its own.
BLOCK_BYTES = 1 << 22
#: Items, terms and documents of a tile: 2 and 8 MB of doubles.
ITEM_TILE, TERM_TILE, DOC_TILE = 256, 1024, 1024
EXACT = 1 << 53
#: Parts that an item's rows from all tasks are ranked in before the last ranking.
SALTS = 64

#: Bytes of terms to themselves, A-Z to lower case, all others to a space.
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))

SCHEMA = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and bytes of characters beyond ASCII; only A-Z are lower-cased."""
    return (text or b"").translate(TERM_BYTES).split()


class ItemBlock:
    """Items with their terms numbered: ``ids[starts[i]:starts[i + 1]]`` are the terms of item i, sorted, ``counts`` their repeats."""

    def __init__(self) -> None:
        self.items: list[int | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.found: list[Counter] = []
        self.size = 0

    def add(self, item_id: int | None, text: bytes) -> None:
        counted = Counter(terms(text))
        self.items.append(item_id)
        self.found.append(Counter({self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in counted.items()}))
        self.size += len(text)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *map(len, self.found)])
        ids = np.array([t for f in self.found for t in sorted(f)], np.int64)
        counts = np.array([f[t] for f in self.found for t in sorted(f)], np.int64)
        return starts, ids, counts


def item_blocks(rows: Iterable, limit: int | None = None) -> Iterator[ItemBlock]:
    """Blocks of rows (item_id, text) in their order, of ``limit`` bytes of text at most unless one item has more."""
    limit = BLOCK_BYTES if limit is None else limit
    block = ItemBlock()
    for item_id, text in rows:
        data = (text or "").encode()
        if block.items and block.size + len(data) > limit:
            yield block
            block = ItemBlock()
        block.add(item_id, data)
    if block.items:
        yield block


def matched(spark: SparkSession, docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, counts) of documents with terms: how many, and the repeats of each that is in the vocabulary."""
    shared = spark.sparkContext.broadcast(vocabulary)

    def make():
        known = shared.value

        def on_batch(batch: pa.RecordBatch):
            rows, ids, counts, sizes = [], [], [], []
            for at, text in enumerate(column_bytes(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                hits = Counter(map(known.get, words))
                hits.pop(None, None)
                rows.append((at, len(words)))
                ids += hits
                counts += hits.values()
                sizes.append(len(hits))
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), *lists], ["doc_id", "n", "ids", "counts"])

        return on_batch

    return map_batches(docs, make, "doc_id long, n long, ids array<int>, counts array<int>")


def weight(n_docs: int, df: int) -> int:
    """Weight of a term in a thousandth of a nat."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    """Length of a document in hundredths of the mean, a quarter of it counted."""
    return 100 - 25 + (25 * n * n_docs) // n_terms


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right`` of whole numbers not below 0, in 64-bit integers; BLAS wherever no sum can pass 2^53."""
    top = int(right.max(initial=0))
    if int(left.max(initial=0)) < EXACT and int(left.sum(axis=1).max(initial=0)) * top < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    if left.shape[1] == 1:
        return left * right
    half = left.shape[1] // 2
    return products(left[:, :half], right[:half]) + products(left[:, half:], right[half:])


class Best:
    """The best documents so far of the items of a tile."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.floor = np.ones(n_items, np.int64)
        self.kept = [np.empty(0, np.int64) for _ in range(4)]

    def add(self, scores: np.ndarray, docs: np.ndarray, unknown: np.ndarray) -> None:
        """``scores`` of items by documents; those at an item's floor are kept for now, as their ids may be smaller."""
        item, at = np.nonzero(scores >= self.floor[:, None])
        parts = [item, scores[item, at], unknown[at], docs[at]]
        item, score, null, doc = (np.concatenate(x) for x in zip(self.kept, parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, null, doc = item[order], score[order], null[order], doc[order]
        first = np.searchsorted(item, item, "left")
        rank = np.arange(len(item)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]
        self.kept = [item[keep], score[keep], null[keep], doc[keep]]


def impacts(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 12 * factors)


def score_tile(starts: np.ndarray, ids: np.ndarray, weights: np.ndarray, items: range, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of the items of a tile by ``n_docs`` documents, whose entries (doc, term, impact) are sorted by term."""
    a, b = starts[items.start], starts[items.stop]
    own, own_weight = ids[a:b], weights[a:b]
    row = np.repeat(np.arange(len(items)), np.diff(starts[items.start : items.stop + 1]))
    total = np.zeros((len(items), n_docs), np.int64)
    vocabulary = np.intersect1d(own, term)
    for at in range(0, len(vocabulary), TERM_TILE):
        tile = vocabulary[at : at + TERM_TILE]
        left = np.zeros((len(items), len(tile)), np.int64)
        column = np.minimum(np.searchsorted(tile, own), len(tile) - 1)
        here = tile[column] == own
        left[row[here], column[here]] = own_weight[here]
        lo, hi = np.searchsorted(term, [tile[0], tile[-1] + 1])
        right = np.zeros((len(tile), n_docs), np.int64)
        column = np.searchsorted(tile, term[lo:hi])
        here = tile[np.minimum(column, len(tile) - 1)] == term[lo:hi]
        right[column[here], doc[lo:hi][here]] = impact[lo:hi][here]
        total += products(left, right)
    return total


def best_documents(spark: SparkSession, postings: DataFrame, block: ItemBlock, weight_of: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(row, item_id, doc_id, score): the best of each task's documents for each item of the block."""
    starts, ids, counts = block.packed()
    shared = spark.sparkContext.broadcast((block.items, starts, ids, counts * weight_of[ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, ids, weights = shared.value
        tiles = [range(at, min(at + ITEM_TILE, len(items))) for at in range(0, len(items), ITEM_TILE)]
        best = [Best(len(t), k) for t in tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                piece = batch.slice(at, DOC_TILE)
                lists = piece.column(2)
                size = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(piece.num_rows), size)
                term = lists.flatten().to_numpy().astype(np.int64)
                factor = np.array([length_factor(n, n_docs, n_terms) for n in piece.column(1).to_pylist()], np.int64)
                impact = impacts(piece.column(3).flatten().to_numpy().astype(np.int64), factor[doc])
                order = np.argsort(term, kind="stable")
                doc, term, impact = doc[order], term[order], impact[order]
                key = piece.column(0)
                unknown = np.asarray(key.is_null()).astype(np.int64)
                key = key.fill_null(0).to_numpy()
                for tile, found in zip(tiles, best, strict=True):
                    found.add(score_tile(starts, ids, weights, tile, doc, term, impact, piece.num_rows), key, unknown)
        for tile, found in zip(tiles, best, strict=True):
            item, score, null, doc = found.kept
            row = item + tile.start
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array([items[i] for i in row.tolist()], pa.int64()), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["row", "item_id", "doc_id", "score"]
            )

    return postings.mapInArrow(run, "row long, item_id long, doc_id long, score long")


def ranked(tops: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item by score and ascending doc_id, nulls last; first in parts, as every task gives some."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = tops.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank from 1, doc_id, score; fewer where fewer score above 0.

    Null and empty texts have no terms: such items get no rows, such documents are never found. Repeated items are ranked each by itself, repeated
    documents are each found; null ids stay null and lose ties. Texts of any length are read whole. Items may be many: each block of BLOCK_BYTES is one more pass over the
    documents. Empty tables give no rows; other columns are not read.
    """
    scratch = Scratch(spark, "lexical")
    corpus = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    queries = items.select(items[item_id].cast("long"), items[text])
    found = []
    for number, block in enumerate(item_blocks(queries.toLocalIterator())):
        if not block.vocabulary:
            continue
        postings = scratch.save(matched(spark, corpus, block.vocabulary), f"postings-{number}", "zstd")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weight_of = np.full(len(block.vocabulary), weight(n_docs, 0), np.int64)
        for term, df in postings.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).toLocalIterator():
            weight_of[term] = weight(n_docs, df)
        found.append(scratch.save(ranked(best_documents(spark, postings, block, weight_of, n_docs, n_terms, k), k), f"ranked-{number}"))
        scratch.drop(f"postings-{number}")
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, found)


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: item_id, rank, doc_id, score."""
    return search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
