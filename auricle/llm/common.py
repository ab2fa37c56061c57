"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.shared import Scratch

__all__ = ["WORD", "Scratch", "column_bytes", "connected_components", "edge_checksum", "fresh", "hot_keys", "map_batches", "sliced", "spread_join"]

#: ASCII white space, the separator of words throughout (``bytes.split`` uses the same set).
WORD = "[^\\x20\\x09-\\x0D]+"

#: A key is hot if it has over one in so many rows; there can't be more hot keys than this.
HOT_KEYS = 1000
#: Rows with texts that a Python worker works on at a time.
SLICE = 500
SALTS = 64


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task setup: ``make()`` runs once a task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on_batch = make()
        for batch in batches:
            yield from on_batch(batch)

    return df.mapInArrow(run, schema)


def sliced(on_slice: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A batch function that gives ``on_slice`` SLICE rows at a time, so a worker holds the texts and results of so many."""

    def on_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, SLICE):
            yield from on_slice(batch.slice(at, SLICE))

    return on_batch


def hot_keys(counts: DataFrame, key: str) -> list:
    """Keys of (key, n) that hold over one in HOT_KEYS of all rows: fewer than HOT_KEYS of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return [r[key] for r in counts.where(F.col("n") * HOT_KEYS > total).select(key).collect()]


def spread_join(rows: DataFrame, few: DataFrame, key: str, hot: list, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few`` (a row a key) on ``key``; the rows of hot keys are dealt over SALTS parts by the columns ``by``.

    ``few`` is the side to hash, as its keys are distinct and so spread evenly; ``rows`` need no sort then.
    """
    if not hot:
        return rows.join(few.hint("shuffle_hash"), key, how)
    is_hot = F.col(key).isin(hot)
    left = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = few.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("shuffle_hash"), [key, "salt"], how).drop("salt")


def edge_checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list: root is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round takes minima with partial
    aggregation and joins them back: a hub's edges stream past its one minimum, in one task
    unless adaptive execution splits them, and are never held as a group. Each round is
    written to the shared folder. Rows with a null end are ignored; no edges give no rows.
    """
    scratch = Scratch(spark, "components")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = scratch.save(now, "0")
    before, step = edge_checksum(now), 0
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        step += 1
        now = scratch.save(small.select("e.u", "e.v").where("u <> v").distinct(), str(step))
        scratch.drop(str(step - 1))
        after = edge_checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
