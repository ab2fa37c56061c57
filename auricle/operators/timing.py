"""Word timing and segments.

Results with a clip a row (tokens and timestamps as arrays) are timed row by row in one Arrow stage,
without any exchange. Tokens in long form (a token a row) are put together in runs where they lie; clips of a bounded length are then timed
as rows are. Longer clips are scanned in ranges: windows run within a range of a clip, and
a row a range carries what the next ones need, so a clip with half of all tokens is still many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auricle.shared import Scratch

# Length of a clip's last token, words in a segment without a sentence end.
LAST_TOKEN_S = 0.1
MAX_SEGMENT_WORDS = 15
MARK = "▁"
#: White space of any script.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Places of a clip that one group of a scan holds.
RANGE = 8192
#: Clips whose places stay below so many ranges are timed whole.
WHOLE = 16
#: Tokens that a Python worker times at a time, but for a clip of more.
SLICE = 100_000
WORD_TYPE = "array<struct<word:string,start:double,end:double>>"
SEGMENT_TYPE = "array<struct<id:int,start:double,end:double,text:string>>"


def explode_tokens(results: DataFrame, strict: bool = False) -> DataFrame:
    """(clip_id, pos, token, ts) of results with tokens and timestamps.

    Timestamps beyond the tokens stay, with a null token, as they end the last one; tokens beyond
    the timestamps go. A leading mark becomes a space, unless ``strict``.
    """
    # no filter, which would be pushed down to where the arrays are made and make them anew at each mention
    long = results.select("clip_id", "tokens", F.posexplode(F.when(F.size("tokens") > 0, F.col("timestamps"))).alias("pos", "ts"))
    token = F.get("tokens", F.col("pos"))
    return long.select("clip_id", "pos", (token if strict else F.replace(token, F.lit(MARK), F.lit(" "))).alias("token"), "ts")


def _ranged(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with their range: RANGE places of a clip, so a clip of any length is many small groups."""
    return rows.withColumn("range", F.floor(F.col(by) / RANGE).cast("long"))


def _in_range(by: str):
    return Window.partitionBy("clip_id", "range").orderBy(by)


def _ranges():
    """Over a clip's ranges, of which there is a row each."""
    return Window.partitionBy("clip_id").orderBy("range")


def _earlier():
    return _ranges().rowsBetween(Window.unboundedPreceding, -1)


def _with_carries(rows: DataFrame, of_range: dict[str, F.Column], *carries: dict[str, F.Column]) -> DataFrame:
    """``rows`` with what each range takes over from the others of its clip: ``of_range`` aggregates a range, each of ``carries`` runs over these.

    Aggregates are partial before any exchange, so one row a range is all that runs over a clip. Rows are exchanged by range for the join, which
    the windows within ranges then share.
    """
    sums = rows.groupBy("clip_id", "range").agg(*[c.alias(name) for name, c in of_range.items()])
    for step in carries:
        sums = sums.withColumns(step)
    carried = sums.select("clip_id", "range", *[name for step in carries for name in step])
    return rows.join(carried.hint("shuffle_hash"), ["clip_id", "range"])


def _time_carries() -> tuple[dict[str, F.Column], dict[str, F.Column]]:
    """Aggregate and carry of a clip's time: a range's last token ends where the next range's first one starts."""
    return {"head_ts": F.min_by("ts", "pos")}, {"after": F.lead("head_ts").over(_ranges())}


def _timed(rows: DataFrame) -> DataFrame:
    following = F.coalesce(F.lead(F.struct("ts")).over(_in_range("pos")), F.struct(F.col("after").alias("ts")))["ts"]
    start = F.col("ts").cast("double")
    return rows.withColumns({"start": start, "end": F.coalesce(following.cast("double"), start + LAST_TOKEN_S)})


def token_intervals(tokens: DataFrame) -> DataFrame:
    """``tokens`` with start and end: a token ends where the next starts, the last after 0.1 s. Null tokens are then dropped.

    Places (``pos``) of a clip differ. A range of a clip's tokens takes the time of the next range's first one, so long clips are spread over tasks.
    """
    rows = _with_carries(_ranged(tokens, "pos"), *_time_carries())
    return _timed(rows).where("token is not null").select(*tokens.columns, "start", "end")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the trimmed token, null if blank, and whether it opens a word."""
    clean = F.btrim("token", F.lit(WHITE))
    return rows.withColumn("clean", F.when(clean != "", clean)).withColumn("opens", F.when(F.col("clean").isNotNull(), F.col("token").startswith(" ").cast("long")))


def _word_carries() -> tuple[dict[str, F.Column], dict[str, F.Column]]:
    """Aggregates and carries of a clip's words, which are numbered from 0 whether its first token opens one or not."""
    head = F.min_by("opens", F.when(F.col("opens").isNotNull(), F.col("pos")))
    before = F.coalesce(F.sum("opened").over(_earlier()), F.lit(0))
    first = F.first("head", ignorenulls=True).over(_ranges().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return {"opened": F.coalesce(F.sum("opens"), F.lit(0)), "head": head}, {"before": before - first, "high": before - first + F.col("opened")}


def _united(rows: DataFrame, number: str, name: str, text: F.Column, sign: str) -> DataFrame:
    """Rows of a range put together by ``number``, and those that may go on in another range, its first and last ones, by clip.

    What a range gives needs no further exchange; two rows a range are exchanged. The ranges' rows are written to the shared folder in between.
    """
    inside = rows.groupBy("clip_id", "range", number)
    edge = F.bool_or((F.col(number) == F.col("low_edge")) | (F.col(number) == F.col("high_edge")))
    parts = inside.agg(text.alias(name), F.min_by("start", "at").alias("start"), F.max_by("end", "at").alias("end"), edge.alias("edge"))
    parts = Scratch(rows.sparkSession, "timing").save(parts, name)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", name))), lambda p: p[name]), sign)
    across = parts.where("edge").groupBy("clip_id", number).agg(joined.alias(name), F.min_by("start", "range").alias("start"), F.max_by("end", "range").alias("end"))
    return parts.where("not edge").select(*across.columns).unionByName(across)


def _in_order(name: str) -> F.Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda t: t[name])


def _words(rows: DataFrame) -> DataFrame:
    """Words of marked and timed tokens with their carries."""
    number = F.col("before") + F.sum("opens").over(_in_range("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.where("clean is not null").select("clip_id", "range", number.cast("int").alias("word_id"), F.col("pos").alias("at"), "clean", "start", "end", F.col("before").alias("low_edge"), F.col("high").alias("high_edge"))
    return _united(kept, "word_id", "word", F.array_join(_in_order("clean"), ""), "").select("clip_id", "word_id", "word", "start", "end")


def build_words(intervals: DataFrame) -> DataFrame:
    """(clip_id, word_id, word, start, end): tokens with a leading space open a word, blank ones are skipped.

    Each range counts the words it opens and goes on from those before it. Words are written to the shared folder.
    """
    return _words(_with_carries(_marked(_ranged(intervals, "pos")), *_word_carries()))


def sentence_end(word: F.Column) -> F.Column:
    return F.right(word, F.lit(1)).isin(".", "!", "?")


def build_segments(words: DataFrame) -> DataFrame:
    """(clip_id, id, start, end, text): cut after a word that ends a sentence, and after 15 words. A clip's word ids run without gaps.

    A range of words knows the cuts after its first sentence end by itself; those before it follow from where the sentence it begins in
    has begun. So ranges take over that place and the number of cuts before them. Segments are written to the shared folder.
    """
    whole = lambda n: F.ceil(n / MAX_SEGMENT_WORDS)
    stop = F.when(sentence_end(F.col("word")), F.col("word_id"))
    rows = _ranged(words, "word_id")
    of_range = {"stops": F.sort_array(F.collect_list(stop)), "low": F.min("word_id"), "high": F.max("word_id")}
    bounds = F.concat("stops", F.array("high"))
    inner = F.aggregate(F.zip_with(F.slice(bounds, 2, F.size("stops")), "stops", lambda b, a: whole(b - a)), F.lit(0).cast("long"), lambda n, x: n + x)
    earlier = {"stopped": F.max(F.array_max("stops")).over(_earlier()), "first": F.first("low").over(_ranges())}
    place = F.col("low") - F.coalesce(F.col("stopped") + 1, F.col("first"))
    lead = F.coalesce(F.get("stops", F.lit(0)), F.col("high")) - F.col("low") + 1
    cuts = {"cuts": whole(place + lead) - whole(place) + F.when(F.size("stops") > 0, inner).otherwise(0)}
    rows = _with_carries(rows, of_range, earlier, cuts, {"before": F.coalesce(F.sum("cuts").over(_earlier()), F.lit(0))})
    stopped = F.coalesce(F.max(stop).over(_in_range("word_id").rowsBetween(Window.unboundedPreceding, -1)), F.col("stopped"))
    cut = (F.col("word_id") - F.coalesce(stopped + 1, F.col("first"))) % MAX_SEGMENT_WORDS == 0
    number = F.col("before") + F.sum(F.col("cut").cast("long")).over(_in_range("word_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    edges = [(F.col("before") - 1).alias("low_edge"), (F.col("before") + F.col("cuts") - 1).alias("high_edge")]
    rows = rows.withColumn("cut", cut).select("clip_id", "range", number.cast("int").alias("id"), F.col("word_id").alias("at"), "word", "start", "end", *edges)
    return _united(rows, "id", "text", F.array_join(_in_order("word"), " "), " ").select("clip_id", "id", "start", "end", "text")


def packed_runs(tokens: DataFrame) -> DataFrame:
    """(clip_id, first, ranged, tokens, stamps): tokens (clip_id, pos, token, ts) whose places follow each other, put together where they lie.

    A run is ``ranged`` if its clip can't be timed whole: it has places below 0 or beyond WHOLE ranges, or a null time. Rows without a clip or place are left out.
    """
    most = WHOLE * RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, pos = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if not np.all((code[1:] > code[:-1]) | ((code[1:] == code[:-1]) & (pos[1:] > pos[:-1]))):
                order = np.lexsort((pos, code))
                batch, code, pos = batch.take(pa.array(order)), code[order], pos[order]
            at = np.flatnonzero(_changes(code, pos - np.arange(len(pos))))
            if not len(at):
                continue
            ends = np.append(at[1:], len(pos))
            untimed = np.add.reduceat(batch.column(3).is_null().to_numpy(zero_copy_only=False).astype(np.int64), at)
            ranged = (pos[at] < 0) | (pos[ends - 1] >= most) | (untimed > 0)
            offsets = pa.array(np.append(at, len(pos)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pos[at]), pa.array(ranged), *lists], ["clip_id", "first", "ranged", "tokens", "stamps"])

    kind = tokens.schema["clip_id"].dataType.simpleString()
    rows = tokens.where("clip_id is not null and pos is not null").select("clip_id", "pos", "token", "ts")
    return rows.mapInArrow(run, f"clip_id {kind}, first long, ranged boolean, tokens array<string>, stamps array<{tokens.schema['ts'].dataType.simpleString()}>")


def _whole_clips(runs: DataFrame) -> DataFrame:
    """(clip_id, words, segments) of runs, a clip's in one task: exchanged and sorted as rows of many tokens each."""

    def lists(runs: pa.Array, opens: np.ndarray) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(runs).to_numpy())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends])[np.append(opens, len(runs))].astype(np.int32)), runs.flatten())

    def timed(batch: pa.RecordBatch, opens: np.ndarray) -> Iterator[pa.RecordBatch]:
        clips = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(opens)), lists(batch.column(2), opens), lists(batch.column(3), opens)], ["clip_id", "tokens", "stamps"])
        for piece in slices(clips, 1, SLICE):
            yield pa.RecordBatch.from_arrays([piece.column(0), *timed_batch(piece.column(1), piece.column(2), True)], ["clip_id", "words", "segments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last clip's runs, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            opens = np.flatnonzero(_changes(batch.column(0).dictionary_encode().indices.to_numpy()))
            held = batch.slice(opens[-1])
            if len(opens) > 1:
                yield from timed(batch.slice(0, opens[-1]), opens[:-1])
        if held is not None:
            yield from timed(held, np.zeros(1, np.int64))

    rows = runs.select("clip_id", "first", "tokens", "stamps").repartition("clip_id").sortWithinPartitions("clip_id", "first")
    return rows.mapInArrow(run, f"clip_id {runs.schema['clip_id'].dataType.simpleString()}, words {WORD_TYPE}, segments {SEGMENT_TYPE}")


def _scanned(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, segments), ranges at a time. Tokens are read twice, for their ranges' sums and for themselves, and exchanged once, by range."""
    aggregates, carries = zip(_time_carries(), _word_carries(), strict=True)
    rows = _with_carries(_marked(_ranged(tokens, "pos")), aggregates[0] | aggregates[1], carries[0] | carries[1])
    words = _words(_timed(rows))
    return words, build_segments(words)


def time_tokens(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, segments) of tokens in long form, which are read once, in any order, and written to the shared folder as runs.

    Places (``pos``) of a clip differ. Clips are timed whole, but for those with places beyond WHOLE ranges, which are scanned in ranges.
    """
    scratch = Scratch(tokens.sparkSession, "tokens")
    runs = scratch.save(packed_runs(tokens), "runs")
    far = runs.where("ranged").select("clip_id").distinct()
    if far.isEmpty():
        timed = _whole_clips(runs)
        return words_of(timed), segments_of(timed)
    timed = scratch.save(_whole_clips(runs.join(far, "clip_id", "left_anti")), "whole")
    apart = runs.join(far, "clip_id", "left_semi").select("clip_id", "first", F.posexplode(F.arrays_zip("tokens", "stamps")).alias("i", "t"))
    words, segments = _scanned(apart.select("clip_id", (F.col("first") + F.col("i")).alias("pos"), F.col("t.tokens").alias("token"), F.col("t.stamps").alias("ts")))
    return words_of(timed).unionByName(words), segments_of(timed).unionByName(segments)


def nest_timing(clips: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """``clips`` with arrays words and segments; null where a clip has none."""
    w = words.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word", "start", "end"))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("words"))
    s = segments.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))).alias("segments"))
    return clips.join(w, "clip_id", "left").join(s, "clip_id", "left")


def timed_tokens(results: DataFrame, strict: bool = False) -> DataFrame:
    """(clip_id, pos, token, ts, start, end) of results, straight from the arrays: what ``explode_tokens`` and ``token_intervals`` give, without an exchange."""
    used = F.when(F.size("timestamps") > 0, F.slice("tokens", F.lit(1), F.size("timestamps")))
    long = results.select("clip_id", "timestamps", F.posexplode(used).alias("pos", "token"))
    ts = F.get("timestamps", F.col("pos"))
    start = ts.cast("double")
    end = F.coalesce(F.get("timestamps", F.col("pos") + 1).cast("double"), start + LAST_TOKEN_S)
    token = F.col("token") if strict else F.replace("token", F.lit(MARK), F.lit(" "))
    return long.where("token is not null").select("clip_id", "pos", token.alias("token"), ts.alias("ts"), start.alias("start"), end.alias("end"))


def _lists(row: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.Array:
    """One list of structs for each of ``n`` rows, given each struct's row in order; null where there is none."""
    sizes = np.bincount(row, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=pa.array(sizes == 0))


def _joined(parts: pa.Array, first: np.ndarray, sign: str) -> pa.Array:
    """Strings joined in groups; ``first`` tells which parts open one."""
    offsets = np.append(np.flatnonzero(first), len(parts)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), parts), sign)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any key differs from the place before; the first place counts."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first


def timed_batch(tokens: pa.Array, stamps: pa.Array, strict: bool) -> tuple[pa.Array, pa.Array]:
    """Words and segments of each clip of a batch, all clips at once over the arrays' flat values."""
    n_tokens, n_stamps = (pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in (tokens, stamps))
    used = np.minimum(n_tokens, n_stamps)
    row = np.repeat(np.arange(len(tokens)), used)
    pos = np.arange(used.sum()) - np.repeat(np.cumsum(used) - used, used)
    at = (np.cumsum(n_stamps) - n_stamps)[row] + pos
    ts = stamps.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = ts[at]
    end = np.where(pos + 1 < n_stamps[row], ts[np.minimum(at + 1, len(ts) - 1)], start + LAST_TOKEN_S) if len(at) else start
    token = tokens.flatten().take(pa.array((np.cumsum(n_tokens) - n_tokens)[row] + pos))
    if not strict:
        token = pc.replace_substring(token, MARK, " ")
    clean = pc.utf8_trim(token, WHITE)
    kept = pc.fill_null(pc.not_equal(clean, ""), False).to_numpy(zero_copy_only=False)
    row, start, end, token, clean = row[kept], start[kept], end[kept], token.filter(pa.array(kept)), clean.filter(pa.array(kept))
    # a token with a leading space opens a word, as does a clip's first
    opens = _changes(row) | pc.starts_with(token, " ").to_numpy(zero_copy_only=False)
    last = np.append(opens[1:], True)[: len(opens)]
    word, w_row, w_start, w_end = _joined(clean, opens, ""), row[opens], start[opens], end[last]
    words = _lists(w_row, len(tokens), {"word": word, "start": pa.array(w_start), "end": pa.array(w_end)})
    # a segment opens with a clip, after a word that ends a sentence, and after MAX_SEGMENT_WORDS words of one
    ends = pc.or_(pc.or_(pc.ends_with(word, "."), pc.ends_with(word, "!")), pc.ends_with(word, "?")).to_numpy(zero_copy_only=False)
    sentence = _changes(w_row) | np.append(True, ends[:-1])[: len(ends)]
    at = np.arange(len(word))
    place = at - np.maximum.accumulate(np.where(sentence, at, 0)) if len(at) else at
    cut = sentence | (place % MAX_SEGMENT_WORDS == 0)
    last = np.append(cut[1:], True)[: len(cut)]
    s_row = w_row[cut]
    first = _changes(s_row)
    at = np.arange(len(s_row))
    number = at - np.maximum.accumulate(np.where(first, at, 0)) if len(at) else at
    fields = {"id": pa.array(number.astype(np.int32)), "start": pa.array(w_start[cut]), "end": pa.array(w_end[last]), "text": _joined(word, cut, " ")}
    return words, _lists(s_row, len(tokens), fields)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into pieces of at most ``most`` values in a column of lists, or of one row."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at, done = np.cumsum(sizes), 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def with_timing(results: DataFrame, strict: bool = False, made: tuple[str, ...] = ("words", "segments"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """``results`` (tokens, timestamps) with arrays ``words`` and ``segments``, null where a clip has none.

    One Arrow stage over the rows as they lie: no exchange, no sort. Tokens beyond the timestamps go,
    timestamps beyond the tokens end the last one; null tokens are skipped, timestamps hold no nulls. Null or
    empty arrays give nulls; columns named like the result's are replaced. ``made`` and ``keep`` name the arrays and the other columns wanted, all unless given.
    """
    kept = [f for f in results.schema.fields if f.name not in ("words", "segments") and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    types = {"words": WORD_TYPE, "segments": SEGMENT_TYPE}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{name} {types[name]}" for name in made)])

    read = [*names, *(c for c in ("tokens", "timestamps") if c not in names)]
    t, s = read.index("tokens"), read.index("timestamps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, t, SLICE):
                arrays = dict(zip(types, timed_batch(piece.column(t), piece.column(s), strict), strict=True))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], *(arrays[name] for name in made)], [*names, *made])

    return results.select(*read).mapInArrow(run, schema)


def words_of(timed: DataFrame) -> DataFrame:
    """(clip_id, word_id, word, start, end) of ``with_timing``'s rows."""
    return timed.select("clip_id", F.posexplode("words").alias("word_id", "w")).select("clip_id", "word_id", "w.word", "w.start", "w.end")


def segments_of(timed: DataFrame) -> DataFrame:
    """(clip_id, id, start, end, text) of ``with_timing``'s rows."""
    return timed.select("clip_id", F.inline("segments"))
