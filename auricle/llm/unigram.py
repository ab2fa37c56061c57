"""SentencePiece tokenization by Viterbi search: counts, ids and decoding.

Pieces and scores come from a ``.model`` file. A text is normalised as the model says
(identity normalisation only). Each text goes through one stream that commits ids where all
surviving paths meet. Boundaries that no piece can cross, as before a space, are such places by the vocabulary alone;
the segments between them are memoised, as most recur.

The search runs over the vocabulary matches that an Aho-Corasick automaton lists by their end, and
keeps one path for each boundary. Which match continues a path depends on the model's type:

- Unigram: the best sum of scores. Tie rule, the tokenizer's own: candidates for a boundary are
  taken by ascending start, and a later one replaces an earlier one only if its score is strictly
  higher. Scores are added in double precision from the last committed boundary.
- BPE, which the vocabulary at hand is, so the registered queries take this rule and no score decides
  there: sums of scores don't give a BPE tokenizer's ids. Ids are those of the merges if and only
  if every two neighbours are what the merges make of their joined text, so the match
  that fits the path's last piece continues it; there is one for each boundary.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.llm.common import map_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments up to this many characters are memoised, up to MEMO entries a Python worker.
MEMO_CHARS = 48
MEMO = 600_000
#: A segment of more characters is searched part by part; texts are read in parts of PART characters.
LONG = 256
PART = 1 << 16
#: Pairs of pieces whose fit is remembered.
PAIRS = 400_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces of a SentencePiece model with what the search needs."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.normalizer_spec.precompiled_charsmap:
            raise ValueError("only models with identity normalisation are supported")
        self.bpe = proto.trainer_spec.model_type == BPE
        if not self.bpe and proto.trainer_spec.model_type != UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        kinds = list(zip(proto.pieces, range(len(self.pieces)), strict=True))
        normal = [p.score for p, _ in kinds if p.type == NORMAL]
        self.unknown_id = self.types.index(UNKNOWN)
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.bytes = {int(p.piece[3:5], 16): i for p, i in kinds if p.type == BYTE} if proto.trainer_spec.byte_fallback else {}
        self.automaton = ahocorasick.Automaton()
        alphabet, crossing = set(), False
        self.longest = 1
        if self.bpe:
            self.merges = {p.piece: (p.score, i) for p, i in kinds if p.type == NORMAL and p.piece}
            if any(p.type in (USER_DEFINED, UNUSED) for p, _ in kinds):
                raise ValueError("BPE models with user-defined or unused pieces are not supported")
        self.pairs: dict[int, bool] = {}
        self.special = frozenset(i for i, t in enumerate(self.types) if t in (BYTE, UNKNOWN, CONTROL))
        self.is_special = np.isin(np.arange(len(self.pieces)), list(self.special))
        for p, i in kinds:
            if self.bpe and p.type == NORMAL and len(p.piece) > 1 and self.merged(p.piece) != [p.piece]:
                continue  # no merges lead to it
            if p.type in (NORMAL, USER_DEFINED) and p.piece:
                score = len(p.piece.encode()) * max(normal) - 0.1 if p.type == USER_DEFINED else p.score
                self.automaton.add_word(p.piece, (len(p.piece), score, i))
                alphabet.update(p.piece)
                crossing |= SPACE in p.piece.lstrip(SPACE)
                self.longest = max(self.longest, len(p.piece))
        self.automaton.make_automaton()
        alone = "".join(c for c in "\t\n\v\f\r" if c not in alphabet)
        stop = f"{SPACE}{re.escape(alone)}"
        # without pieces that hold a space after another character, a space opens a segment
        self.segments = re.compile(r"[\s\S]+" if crossing else f"{SPACE}+[^{stop}]*|[^{stop}]+" + (f"|[{re.escape(alone)}]" if alone else ""))

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """Symbols that BPE merges make of a short text: the best-scored neighbours first, from the left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                hit = self.merges.get(parts[k] + parts[k + 1])
                if hit is not None and (best is None or hit[0] > best):
                    best, at = hit[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep two pieces apart that follow each other; remembered in ``pairs``."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.pieces[left], self.pieces[right]
        known = self.pairs[left << 20 | right] = self.merged(a + b) == [a, b]
        return known

    def unknown_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown_id]


@lru_cache(2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def count_pieces(vocab: Vocabulary, segment: str) -> int:
    """Number of ids of a segment: Viterbi that carries only score (or last piece) and piece count, no back pointers."""
    n, bpe, pairs, fits = len(segment), vocab.bpe, vocab.pairs, vocab.fits
    state: list = [None if bpe else 0.0] * (n + 1)
    counts, at, single, set_ = [0] * (n + 1), 1, False, False  # ``at``: boundary whose matches are being read

    def unknown(b: int) -> None:
        """Boundary ``b`` by an unknown character, where that is all there is or scores more."""
        score = None if bpe else state[b - 1] + vocab.unknown_score
        if not set_ or (not bpe and score > state[b]):
            state[b], counts[b] = score, counts[b - 1] + len(vocab.unknown_ids(segment[b - 1]))

    for end, (length, score, piece) in vocab.automaton.iter(segment):
        while at <= end:
            if not single:
                unknown(at)
            at, single, set_ = at + 1, False, False
        start = at - length
        if bpe:
            if not set_:
                before = state[start]
                ok = before is None or pairs.get(before << 20 | piece)
                if ok or (ok is None and fits(before, piece)):
                    state[at], counts[at], set_ = piece, counts[start] + 1, True
        elif not set_ or state[start] + score > state[at]:
            state[at], counts[at], set_ = state[start] + score, counts[start] + 1, True
        single |= length == 1
    while at <= n:
        if not single:
            unknown(at)
        at, single, set_ = at + 1, False, False
    return counts[n]


def encode_segment(vocab: Vocabulary, segment: str) -> list[int]:
    """Ids of a short segment: the same search with back pointers, followed once from its end."""
    n, bpe, pairs, fits = len(segment), vocab.bpe, vocab.pairs, vocab.fits
    if not bpe:
        stream = StreamingViterbi(vocab)
        stream.search(segment)
        return stream.finish()
    last: list = [None] * n  # by the boundary's last character, so the start comes last; None: the start, or an unknown character
    last.append(None)
    steps = [1] * n
    known = pairs.get
    for end, (length, _, piece) in vocab.automaton.iter(segment):
        if last[end] is None:
            before = last[end - length]
            if before is None or ((ok := known(before << 20 | piece)) or (ok is None and fits(before, piece))):
                last[end], steps[end] = piece, length
    out, at = [], n - 1
    while at >= 0:
        piece = last[at]
        if piece is None:
            out += vocab.unknown_ids(segment[at])[::-1]
        else:
            out.append(piece)
        at -= steps[at]
    out.reverse()
    return out


class StreamingViterbi:
    """Viterbi over a (normalised) text that comes in parts, with ids given out as soon as they are certain.

    Ids are committed where all surviving paths meet in one boundary. At a boundary that no
    piece of the vocabulary crosses, as before a space, they always do: the segment before it is committed
    there, and as nothing before it matters any more, segments seen before come from ``memo``. In a segment longer
    than LONG characters the back pointers of the last ``longest`` boundaries are followed now and then
    to find where they meet. So what is held is bounded by LONG and the longest piece, however long
    the text. ``commits`` counts the boundaries where paths met.
    """

    def __init__(self, vocab: Vocabulary, memo: dict[str, bytes] | None = None) -> None:
        self.vocab, self.memo = vocab, memo
        self.held, self.commits = "", 0
        self.inside = False  # of a long segment, of which ``held`` is then the last character
        self.begin()

    def begin(self) -> None:
        vocab, self.tail = self.vocab, ""
        self.base = self.at = 0
        self.state: list = [None if vocab.bpe else 0.0] * (vocab.longest + 1)
        # of each boundary after ``base``: length of the last step of its path, and that step's ids
        self.steps: list[int] = []
        self.ids: list = []
        self.due = 4 * vocab.longest

    def push_packed(self, part: str) -> bytes:
        """Ids that the text so far makes certain, as little-endian 32-bit numbers."""
        found = self.vocab.segments.findall(self.held + part)
        if not found:
            return b""
        out: list[bytes] = []
        if self.inside:
            out.append(packed(self.search(found[0][1:])))
            if len(found) == 1:
                self.held = found[0][-1]
                return b"".join(out)
            out.append(packed(self.finish()))
            self.inside, self.commits = False, self.commits + 1
            del found[0]
        self.held = found.pop()
        self.commits += len(found)
        memo = self.memo
        out += map(memo.__getitem__, found) if memo is not None else [packed(encode_segment(self.vocab, x)) for x in found]
        if len(self.held) > LONG:
            self.begin()
            out.append(packed(self.search(self.held)))
            self.inside, self.held = True, self.held[-1]
        return b"".join(out)

    def close_packed(self) -> bytes:
        """The ids left at the end of the text."""
        if self.inside:
            return packed(self.finish())
        if not self.held:
            return b""
        return packed(encode_segment(self.vocab, self.held)) if self.memo is None else self.memo[self.held]

    def push(self, part: str) -> list[int]:
        return np.frombuffer(self.push_packed(part), "<i4").tolist()

    def close(self) -> list[int]:
        return np.frombuffer(self.close_packed(), "<i4").tolist()

    def search(self, part: str) -> list[int]:
        """The next part of one segment."""
        vocab, state, size, skip = self.vocab, self.state, self.vocab.longest + 1, len(self.tail)
        bpe, pairs, fits = vocab.bpe, vocab.pairs, vocab.fits
        seen, at, out = self.tail + part, self.at, []
        begin, best, step, ids, single = at - skip, None, 0, 0, False

        def close() -> None:
            """Boundary at + 1: its best match, or the unknown character."""
            nonlocal at, best, step, ids, single
            here = state[at % size]
            if not single and (best is None or (not bpe and here + vocab.unknown_score > best)):
                best, step, ids = None if bpe else here + vocab.unknown_score, 1, vocab.unknown_ids(seen[at - begin])
            at += 1
            state[at % size] = best
            self.steps.append(step)
            self.ids.append(ids)
            best, single = None, False
            if at - self.base >= self.due:
                self.at = at
                out.extend(self._commit())

        for end, (length, score, piece) in vocab.automaton.iter(seen):
            if end < skip:
                continue
            end += begin
            while at < end:
                close()
            if length == 1:
                single = True
            before = state[(end + 1 - length) % size]
            if bpe:
                if best is None:
                    ok = before is None or pairs.get(before << 20 | piece)
                    if ok or (ok is None and fits(before, piece)):
                        best, step, ids = piece, length, piece
            elif best is None or before + score > best:
                best, step, ids = before + score, length, piece
        while at < begin + len(seen):
            close()
        self.at = at
        self.tail = seen[-vocab.longest :]
        return out

    def _commit(self) -> list[int]:
        alive = set(range(max(self.base, self.at - self.vocab.longest), self.at + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - self.steps[last - self.base - 1])
        met = alive.pop()
        out = self._path(met)
        self.commits += met > self.base
        del self.steps[: met - self.base], self.ids[: met - self.base]
        self.base = met
        if not self.vocab.bpe:  # scores are relative, so a text's length costs no accuracy
            self.state[:] = [x - self.state[self.at % len(self.state)] for x in self.state]
        self.due = 2 * (self.at - self.base) + 4 * self.vocab.longest
        return out

    def _path(self, boundary: int) -> list[int]:
        parts = []
        at = boundary - self.base
        while at > 0:
            ids = self.ids[at - 1]
            parts += [ids] if isinstance(ids, int) else ids[::-1]
            at -= self.steps[at - 1]
        return parts[::-1]

    def finish(self) -> list[int]:
        return self._path(self.at)


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def encode_packed(vocab: Vocabulary, text: str, memo: dict[str, bytes] | None = None) -> bytes:
    """Ids of a whole text, through one stream, as little-endian 32-bit numbers."""
    stream, whole = StreamingViterbi(vocab, memo), vocab.normalise(text)
    return b"".join([*(stream.push_packed(whole[at : at + PART]) for at in range(0, len(whole), PART)), stream.close_packed()])


def encode(vocab: Vocabulary, text: str) -> list[int]:
    return np.frombuffer(encode_packed(vocab, text), "<i4").tolist()


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """Text of ids; byte pieces are joined as UTF-8, control ids give nothing.

    Inverse of ``encode`` but for texts that hold the space mark U+2581 itself (or extra
    spaces, for models that drop them).
    """
    if vocab.special.isdisjoint(ids):
        text = "".join(map(vocab.pieces.__getitem__, ids))
    else:
        parts, pending = [], bytearray()
        for i in ids:
            if vocab.types[i] == BYTE:
                pending.append(int(vocab.pieces[i][3:5], 16))
                continue
            if pending:
                parts.append(pending.decode(errors="replace"))
                pending = bytearray()
            if vocab.types[i] == UNKNOWN:
                parts.append(" ⁇ ")
            elif vocab.types[i] != CONTROL:
                parts.append(vocab.pieces[i])
        parts.append(pending.decode(errors="replace"))
        text = "".join(parts)
    return spaced(vocab, text)


def spaced(vocab: Vocabulary, text: str) -> str:
    """Joined pieces with spaces for their marks, without the one that was put before the text."""
    text = text.replace(SPACE, " ")
    return text[1:] if vocab.dummy_prefix and text.startswith(" ") else text


def decode_lists(vocab: Vocabulary, lists: pa.Array) -> list[str | None]:
    """``decode`` of each list of ids: texts of ordinary pieces alone, nearly all, are joined straight from the flat ids."""
    offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    before = np.concatenate([[0], np.cumsum(vocab.is_special[flat])])
    plain = before[offsets[1:]] == before[offsets[:-1]]
    name, out = vocab.pieces.__getitem__, []
    for a, b, there, simple in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), plain.tolist(), strict=True):
        ids = flat[a:b].tolist()
        out.append(None if not there else spaced(vocab, "".join(map(name, ids))) if simple else decode(vocab, ids))
    return out


class Memo(dict):
    """Segment to its value, worked out on first use; emptied when full, so its size is bounded."""

    def __init__(self, work, limit: int = MEMO) -> None:
        super().__init__()
        self.work, self.limit = work, limit

    def __missing__(self, segment: str):
        value = self.work(segment)
        if len(segment) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[segment] = value
        return value


@lru_cache(2)
def count_memo(model: bytes) -> Memo:
    vocab = vocabulary(model)
    return Memo(lambda s: count_pieces(vocab, s))


@lru_cache(2)
def encode_memo(model: bytes) -> Memo:
    vocab = vocabulary(model)
    return Memo(lambda s: packed(encode_segment(vocab, s)))


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file (at most a few MB), read on the driver and sent to the executors."""
    return Path(path).read_bytes()


def _kept(docs: DataFrame, text: str, added: str) -> tuple[DataFrame, list[str], str]:
    taken = {c.split(" ")[0] for c in added.split(", ")}
    rest = [f for f in docs.schema.fields if f.name != text and f.name not in taken]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), added])
    return docs.select(*[docs[f.name] for f in rest], docs[text]), [f.name for f in rest], schema


def token_counts(spark: SparkSession, docs: DataFrame, text: str = "text", model: bytes | None = None) -> DataFrame:
    """``docs`` without the text and with n_tokens long: ids that ``encode_documents`` would give.

    Null and empty texts count 0; long texts are counted whole; repeated rows each give a row; an
    empty table gives none. Columns named like the result's are replaced.
    """
    rows, rest, schema = _kept(docs, text, "n_tokens long")
    shared = spark.sparkContext.broadcast(read_model() if model is None else model)

    def make():
        vocab, memo = vocabulary(shared.value), count_memo(shared.value)

        def on_batch(batch: pa.RecordBatch):
            counts = [sum(map(memo.__getitem__, vocab.segments.findall(vocab.normalise(x)))) if x else 0 for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*rest, "n_tokens"])

        return on_batch

    return map_batches(rows, make, schema)


def encode_documents(spark: SparkSession, docs: DataFrame, text: str = "text", model: bytes | None = None) -> DataFrame:
    """``docs`` without the text and with ids array<int> and n_ids long.

    Null and empty texts give no ids; texts of any length are read in parts; repeated rows each give
    a row; an empty table gives none. Columns named like the result's are replaced.
    """
    rows, rest, schema = _kept(docs, text, "n_ids long, ids array<int>")
    shared = spark.sparkContext.broadcast(read_model() if model is None else model)

    def make():
        vocab, memo = vocabulary(shared.value), encode_memo(shared.value)

        def on_batch(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                found = [encode_packed(vocab, x, memo) if x else b"" for x in piece.column(piece.num_columns - 1).to_pylist()]
                sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(sizes), ids], [*rest, "n_ids", "ids"])

        return on_batch

    return map_batches(rows, make, schema)


def decode_documents(spark: SparkSession, rows: DataFrame, ids: str = "ids", model: bytes | None = None) -> DataFrame:
    """``rows`` with the ids column replaced by text. Null ids give a null text, no ids an empty one; a column ``text`` is replaced; an empty table stays empty."""
    kept, rest, schema = _kept(rows, ids, "text string")
    shared = spark.sparkContext.broadcast(read_model() if model is None else model)

    def make():
        vocab = vocabulary(shared.value)

        def on_batch(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = decode_lists(vocab, piece.column(piece.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(texts, pa.string())], [*rest, "text"])

        return on_batch

    return map_batches(kept, make, schema)


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, n_tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(spark, docs.select("doc_id", "text"))


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) encoded and decoded again: doc_id, n_ids, ids, decoded_sha256, same.

    ``same`` tells whether the decoded text is the input's; a null text counts as empty.
    """
    marked = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    encoded = encode_documents(spark, marked)
    decoded = decode_documents(spark, encoded.withColumn("copy", F.col("ids")), "copy")
    own = decoded.withColumn("decoded_sha256", F.sha2("text", 256))
    return own.select("doc_id", "n_ids", "ids", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha256")).alias("same"))


def encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, n_ids, ids, decoded_sha256, same."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(spark, docs.select("doc_id", "text"))
