"""Packing documents into training sequences by best fit, longest pieces first.

A document is its token ids and an end id. Documents longer than a window are first cut into full windows; what is
left of each goes, longest first, into the tightest open window that has room, found by a segment tree over remaining
capacities. Windows that stay open are then levelled: the emptiest are poured into the gaps of the fullest,
so only these are cut again, and less than a window is left, which waits for the next block of documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
#: Ids that a task packs at a time, 4 bytes each; a longer document is a block of its own.
BLOCK_IDS = 1 << 22
#: Rows of a batch that are encoded, and rows that are given, at a time.
SLICE, ROWS = 500, 4096
#: Texts are encoded in parts of about this many characters.
PART = 1 << 18

# The pattern that parts words in byte-level BPE, and the token that is one id wherever it occurs.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Characters beyond these may be classed otherwise by another version of Unicode.
EXOTIC = regex.compile(r"[^\x00-ɏ]")
#: A word always ends between such a pair of characters, and no special token holds one.
BREAK = regex.compile(r"(?<=[A-Za-z])(?=[ \n\t0-9])")

COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def read_tokenizer(path: str | None = None) -> bytes:
    """A tokenizers file of a byte-level BPE; without a path, the public one of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes of each token to its id, of a parsed byte-level BPE file; None unless merges come in the order of the ids they make."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["model"]["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
    made = [vocabulary["".join(m)] for m in pairs]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(letter[c] for c in token): n for token, n in vocabulary.items() if token not in special}


class Encoder:
    """The ids of the tokenizers library as little-endian unsigned 32-bit numbers.

    Merging goes through tiktoken on the same file's vocabulary, which is several times as fast and gives the same ids; texts with characters that
    the libraries may class differently, or with a special token, go through the tokenizers library itself.
    """

    def __init__(self, model: bytes) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        ranks = byte_ranks(json.loads(model))
        self.merge = None if ranks is None else tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        if self.merge is None or SPECIAL in text or EXOTIC.search(text):
            return self.library(text)
        return np.array(self.merge(text), "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text, encoded in parts that end where words do. Null and empty texts have none."""
        if not text:
            return b""
        if len(text) <= PART:
            return self.part(text)
        found, at = [], 0
        while at < len(text):
            cut = BREAK.search(text, at + PART)
            end = cut.start() if cut else len(text)
            found.append(self.part(text[at:end]))
            at = end
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One encoder a Python worker, which runs many tasks."""
    return Encoder(model)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that tells which capacities are there."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.there = bytearray(2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.base + capacity
        while node and not self.there[node]:
            self.there[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with room for ``need``, no longer open; None if there is none."""
        node = self.base + need
        while not self.there[node]:
            while node & 1:  # a right child, or the root: nothing further right below this parent
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.base:
            node = 2 * node if self.there[2 * node] else 2 * node + 1
        capacity = node - self.base
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self.there[node] = 0
            node >>= 1
            while node and not self.there[2 * node] and not self.there[2 * node + 1]:
                self.there[node] = 0
                node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Pieces of each window, by their numbers: longest first, ties by number, each into the tightest window with room."""
    windows: list[list[int]] = []
    tree = OpenWindows(size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(windows)
            windows.append([])
        capacity, window = found
        windows[window].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], window)
    return windows


Piece = tuple[int, int, int]  # document, first id, ids


def pour(windows: list[list[Piece]], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows levelled: (full windows, pieces of less than a window that are left). The emptiest go into the gaps of the fullest."""
    fill = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda i: -fill[i])
    n_full = sum(fill) // size
    full = [list(windows[i]) for i in order[:n_full]]
    rest = [p for i in order[n_full:] for p in windows[i]]
    at = 0
    for w, i in zip(full, order[:n_full], strict=True):
        gap = size - fill[i]
        while gap:
            doc, start, length = rest[at]
            took = min(gap, length)
            w.append((doc, start, took))
            gap -= took
            if took == length:
                at += 1
            else:
                rest[at] = doc, start + took, length - took
    return full, rest[at:]


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces cut into windows whose sizes are powers of two, largest first."""
    left, windows = sum(p[2] for p in pieces), []
    queue = list(reversed(pieces))
    while left:
        need = 1 << (left.bit_length() - 1)
        left -= need
        window = []
        while need:
            doc, start, length = queue.pop()
            took = min(need, length)
            window.append((doc, start, took))
            need -= took
            if took < length:
                queue.append((doc, start + took, length - took))
        windows.append(window)
    return windows


class Packer:
    """A task's documents, a block at a time. Pieces that wait for the next block keep their document's ids."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.sequence = size, first
        self.docs: list[tuple[int | None, bytes]] = []
        self.waiting: list[Piece] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        self.docs.append((doc_id, ids))
        self.waiting.append((len(self.docs) - 1, 0, len(ids) // 4))
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[pa.RecordBatch]:
        windows, rest = [], []
        for doc, start, length in self.waiting:
            whole = length // self.size * self.size
            windows += [[(doc, at, self.size)] for at in range(start, start + whole, self.size)]
            if length > whole:
                rest.append((doc, start + whole, length - whole))
        open_windows = []
        for numbers in best_fit_decreasing([p[2] for p in rest], self.size):
            window = [rest[i] for i in numbers]
            (windows if sum(p[2] for p in window) == self.size else open_windows).append(window)
        full, left = pour(open_windows, self.size)
        windows += full
        if last:
            windows += powers_of_two(left)
            left = []
        yield from self.batches(windows)
        known: dict[int, int] = {}
        docs = []
        for doc, _, _ in left:
            if doc not in known:
                known[doc] = len(docs)
                docs.append(self.docs[doc])
        self.docs, self.waiting = docs, [(known[d], s, n) for d, s, n in left]
        self.held = sum(n for _, _, n in left)

    def batches(self, windows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for window in windows:
            offset = 0
            for doc, start, length in window:
                rows.append((doc, start, length, self.sequence, offset))
                offset += length
            self.sequence += 1
            if len(rows) >= ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        docs, starts, lengths, sequences, offsets = zip(*rows, strict=True)
        ids = [self.docs[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(docs, starts, lengths, strict=True)]
        total = [len(self.docs[d][1]) // 4 for d in docs]
        longs = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([longs([self.docs[d][0] for d in docs]), longs(starts), longs(lengths), pa.array(ids, pa.binary()), longs(total), longs(sequences), longs(offsets)], COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, model: bytes | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizers library and ``end_id``. Sequences have ``window`` ids, but for at most one run of shorter
    ones a partition, whose sizes are powers of two, so none needs padding. Partitions pack their own rows; sequence ids
    hold the partition's number, so a task that runs again gives the same ones. Null and empty texts are the end id alone; texts of any length are packed whole;
    a null id stays null; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(read_tokenizer() if model is None else model)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for key, value in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    yield from packer.add(key, encode(value) + end)
        yield from packer.flush(True)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)


def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
