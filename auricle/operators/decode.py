"""CTC decoding of stored logits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the blank token, the unknown token, the word mark, seconds a frame.
BLANKS = ("<blk>", "<blank>", "[blank]")
UNKNOWN = "<unk>"
MARK = "▁"
FRAME_S = 0.08
TRIM = "(?U)^\\s+|\\s+$"


def frame_argmax(frames: DataFrame) -> DataFrame:
    """``frames`` with token_id: the position of the largest logit, the first on ties; null logits give null."""
    return frames.withColumn("token_id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


def ctc_collapse(ids: DataFrame, blank_id: int | Column) -> DataFrame:
    """Frames (clip_id, frame, token_id) whose id is not the previous frame's, and not the blank.

    With a column n_valid, padding frames from there on are left out.
    """
    rows = ids.where("frame < n_valid") if "n_valid" in ids.columns else ids
    previous = F.lag("token_id").over(Window.partitionBy("clip_id").orderBy("frame"))
    kept = rows.withColumn("previous", previous).where(F.col("previous").isNull() | (F.col("previous") != F.col("token_id")))
    return kept.where(F.col("token_id") != blank_id).drop("previous")


def detect_blank_id(vocabulary: DataFrame) -> DataFrame:
    """One row: the first id of a blank token, else the last id."""
    return vocabulary.agg(F.coalesce(F.min(F.when(F.col("token").isin(*BLANKS), F.col("token_id"))), F.max("token_id")).alias("blank_id"))


def lookup_tokens(ids: DataFrame, vocabulary: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """``ids`` with token; ``unknown`` where the vocabulary has none (transducer vocabularies take ""). Spark broadcasts the vocabulary if it is small."""
    return ids.join(vocabulary.select("token_id", "token"), "token_id", "left").withColumn("token", F.coalesce("token", F.lit(unknown)))


def frame_time(frame: Column) -> Column:
    return (frame * F.lit(FRAME_S)).cast("float")


def packed_runs(tokens: DataFrame) -> DataFrame:
    """(clip_id, first, tokens array<string>): tokens (clip_id, pos, token) of successive rows whose places follow each other, put together where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            clips, pos = batch.column(0), batch.column(1)
            code = clips.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            place, known = pc.fill_null(pos, 0).to_numpy(zero_copy_only=False).astype(np.int64), pos.is_valid().to_numpy(zero_copy_only=False)
            first = np.ones(batch.num_rows, bool)
            first[1:] = (code[1:] != code[:-1]) | (place[1:] != place[:-1] + 1) | ~known[1:] | ~known[:-1]
            at = np.flatnonzero(first)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, batch.num_rows).astype(np.int32)), batch.column(2))
            yield pa.RecordBatch.from_arrays([clips.take(pa.array(at)), pos.take(pa.array(at)), lists], ["clip_id", "first", "tokens"])

    kinds = {c: tokens.schema[c].dataType.simpleString() for c in ("clip_id", "pos")}
    return tokens.select("clip_id", "pos", "token").mapInArrow(run, f"clip_id {kinds['clip_id']}, first {kinds['pos']}, tokens array<string>")


def detokenize(tokens: DataFrame) -> DataFrame:
    """(clip_id, text): tokens in order of pos, the mark as a space, trimmed. Runs of tokens are exchanged as one row each, whatever order rows lie in."""
    runs = packed_runs(tokens).groupBy("clip_id").agg(F.collect_list(F.struct("first", "tokens")).alias("runs"))
    placed = F.transform("runs", lambda r: F.transform(r["tokens"], lambda t, i: F.struct((r["first"] + i).alias("pos"), t.alias("token"))))
    ordered = F.sort_array(F.flatten(placed))
    text = F.array_join(F.transform(ordered, lambda t: t["token"]), "")
    return runs.select("clip_id", F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), TRIM, "").alias("text"))


def detokenize_array(tokens: Column) -> Column:
    """Text of an array of tokens in order: joined, the mark as a space, trimmed; null tokens give nothing."""
    return F.regexp_replace(F.replace(F.array_join(tokens, ""), F.lit(MARK), F.lit(" ")), TRIM, "")


def ctc_results(frames: DataFrame, vocabulary: DataFrame, blank_id: int) -> DataFrame:
    """(clip_id, text, tokens, timestamps) of frames (clip_id, frame, logits); clips of blanks only are left out."""
    kept = lookup_tokens(ctc_collapse(frame_argmax(frames).drop("logits"), blank_id), vocabulary)
    ordered = F.array_sort(F.collect_list(F.struct("frame", "token", frame_time(F.col("frame")).alias("ts"))))
    rows = kept.groupBy("clip_id").agg(ordered.alias("t"))
    text = F.replace(F.array_join("t.token", ""), F.lit(MARK), F.lit(" "))
    return rows.select("clip_id", F.regexp_replace(text, TRIM, "").alias("text"), F.col("t.token").alias("tokens"), F.col("t.ts").alias("timestamps"))
