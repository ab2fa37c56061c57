"""Spans of text found by kind: scanning into one table, adding to it, digests and redaction."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.llm.common import fresh, map_batches, sliced

Span = tuple[int, int, int]  # start, number of the kind, end


def scan(docs: DataFrame, kinds: tuple[str, ...], find: Callable[[list[str]], Iterable[tuple[list[Span], list[dict]]]], extra: str) -> DataFrame:
    """(row, doc_id, text_hash, n_<kind>..., base_sha256, base, extra) of documents (doc_id, text).

    ``find`` gives, for each of a list of whole texts, its base spans and further records of the
    struct type ``extra``. ``row`` tells rows apart once the result is written.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    fields = [(n, {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.strip().split(" ") for x in extra.split(","))]
    names = ["row", "doc_id", "text_hash", *(f"n_{k}" for k in kinds), "base_sha256", "base", "extra"]
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, base array<struct<start:int,kind:int,stop:int>>, extra array<struct<{','.join(':'.join(x.strip().split(' ')) for x in extra.split(','))}>>"

    def make():
        def on_slice(batch: pa.RecordBatch):
            counts, digests, bases, extras = [[] for _ in kinds], [], [], []
            for base, more in find([text or "" for text in batch.column(3).to_pylist()]):
                base.sort()
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                bases.append([{"start": s, "kind": k, "stop": e} for s, k, e in base])
                extras.append(more)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(bases, base_type), pa.array(extras, pa.list_(pa.struct(fields)))], names)

        return sliced(on_slice)

    return map_batches(rows, make, schema)


def with_added(found: DataFrame, added: DataFrame, kind: int) -> DataFrame:
    """``found`` with ``all_spans``: the base spans and those of ``added`` (row, start, stop), in order."""
    lists = added.groupBy("row").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.lit(kind).alias("kind"), F.col("stop").cast("int").alias("stop"))).alias("more"))
    joined = found.drop("extra").join(lists, "row", "left")
    return joined.withColumn("all_spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))).drop("more")


def spans_text(spans: str, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``docs`` with each span of ``found.all_spans`` replaced by its kind in brackets, and n_chars to match.

    Spans that overlap are replaced as one, by the first's kind. Rows are matched on doc_id
    and text hash, so rows repeated in full are all redacted.
    """
    own_hash, spans = fresh(docs, "hash"), fresh(docs, "spans")
    marks = found.where(F.size("all_spans") > 0).select(F.col("doc_id").alias("mark_id"), F.col("text_hash").alias("mark_hash"), F.col("all_spans").alias(spans)).dropDuplicates(["mark_id", "mark_hash"])
    hashed = docs.withColumn(own_hash, F.xxhash64("text"))
    joined = hashed.join(marks, hashed["doc_id"].eqNullSafe(marks["mark_id"]) & (hashed[own_hash] == marks["mark_hash"]), "left")
    joined = joined.select(*(hashed[c] for c in docs.columns), marks[spans])
    columns_out = docs.columns
    at = columns_out.index("text")
    size_at = columns_out.index("n_chars") if "n_chars" in columns_out else None

    def make():
        def on_slice(batch: pa.RecordBatch):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            sizes = columns[size_at].to_pylist() if size_at is not None else None
            for i, spans in enumerate(columns[-1].to_pylist()):
                if spans:
                    texts[i] = replaced(texts[i], [(s["start"], s["kind"], s["stop"]) for s in spans], kinds)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, pa.string())
            if sizes is not None:
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], columns_out)

        return sliced(on_slice)

    return map_batches(joined, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def replaced(text: str, spans: list[Span], kinds: tuple[str, ...]) -> str:
    parts, at = [], 0
    for start, kind, stop in sorted(spans):
        if start >= at:
            parts += [text[at:start], f"[{kinds[kind].upper()}]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])
