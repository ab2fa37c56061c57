"""Exact top-k inner-product search with vector-approximation files.

Two tables are made of the vectors: approximation files, which hold one byte a component, and the exact
vectors by row. Queries scan the approximation files only. They give each score a lower and an
upper bound; the k-th best lower bound of all files is a query's floor, and vectors whose upper bound
reaches it are its candidates. Exact vectors are fetched by row in order of upper bound, a batch a query and round,
until no bound left reaches the k-th best exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, map_batches

SCALE = 256
TOP = 5
EVERY = 50
#: Cells a dimension in the approximation.
LEVELS = 256
#: Vectors of one approximation file and bytes of it, at most; queries that meet it at a time.
BLOCK = 65_536
BLOCK_BYTES = 1 << 24
QUERY_BLOCK = 512
#: Vectors of a file whose bounds are worked out at a time.
CHUNK = 4096
#: Exact vectors fetched a query in the first round, as a multiple of k; each round takes GROWTH times as many.
FIRST, GROWTH = 4, 4
#: Query rows of one vector are dealt over so many keys.
SALTS = 8
#: Relative error of a sum in double precision, with room to spare for any number of dimensions.
ROUNDING = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) / 256 in double precision, which is exact for every finite x."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * SCALE) / SCALE
    return np.where(np.isfinite(whole), whole, x)


def integer_vectors(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, vec_id, dim, exact binary) of usable vectors; ``exact`` holds each component as ``scaled``, in double precision."""
    usable = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def make():
        def on_batch(batch: pa.RecordBatch):
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            # -0.0 and 0.0 are one number
            flat = scaled(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
            ends = np.cumsum(sizes)
            exact = [flat[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(exact, pa.binary())], ["row", "vec_id", "dim", "exact"])

        return on_batch

    return scratch.save(map_batches(rows, make, "row long, vec_id long, dim int, exact binary"), "exact")


def _stacked(exact: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(exact), np.float64).reshape(-1, dim)


def approximation_files(rows: DataFrame, block: int) -> DataFrame:
    """(file, dim, rows, low, step, codes): per dimension the file's range is cut into LEVELS cells; a vector keeps the number of its cell, one byte."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, bytes]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal number
            part = held.pop(dim)
            exact = _stacked([x for _, x in part], dim)
            low, high = exact.min(axis=0), exact.max(axis=0)
            # halves first, as the whole range may overflow
            step = np.maximum((high / 2 - low / 2) / (LEVELS / 2), np.maximum(np.abs(low), np.abs(high)) * 1e-12)
            step = np.where(step > 0, step, 1.0)
            codes = np.clip(np.floor(exact / step - low / step), 0, LEVELS - 1).astype(np.uint8)
            number += 1
            columns = [[(task << 33) + number], [dim], [[r for r, _ in part]], [low.tobytes()], [step.tobytes()], [codes.tobytes()]]
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "dim", "rows", "low", "step", "codes"])

        for batch in batches:
            for row, dim, exact in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = held.setdefault(dim, [])
                part.append((row, exact))
                if len(part) >= min(block, max(1, BLOCK_BYTES // dim)):
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return rows.select("row", "dim", "exact").mapInArrow(run, "file long, dim int, rows array<long>, low binary, step binary, codes binary")


def score_bounds(queries: np.ndarray, low: np.ndarray, step: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries x vectors) of the scores, from the cells alone; infinite where doubles don't reach."""
    with np.errstate(over="ignore", invalid="ignore"):
        corner = codes * step + low
        base = queries @ corner.T
        # a component lies up to a cell beyond its corner, and a little to either side by rounding
        slack = ROUNDING * (np.abs(queries) @ (np.abs(corner) + np.abs(low) + step * LEVELS).T)
        lower = base + (np.minimum(queries, 0) @ step)[:, None] - slack
        upper = base + (np.maximum(queries, 0) @ step)[:, None] + slack
    unsure = ~(np.isfinite(lower) & np.isfinite(upper))
    lower[unsure], upper[unsure] = -np.inf, np.inf
    return lower, upper


def _scan(files: DataFrame, packed: DataFrame, on_file, schema: str) -> DataFrame:
    """Every query block past every file: files are dealt out once, the blocks of queries go to each of them.

    Only the files' numbers are broadcast. The blocks are sent once a file, which Spark's size of them does not
    tell, so the join is hinted; of a file's blocks one at a time meets it.
    """
    sent = packed.join(F.broadcast(files.select("file", "dim")), "dim")
    met = sent.join(files.hint("merge"), ["file", "dim"]).select("dim", "rows", "low", "step", "codes", "asked")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def make():
        def on_batch(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                dim, rows, low, step, codes, asked = (batch.column(c)[i].as_py() for c in range(6))
                queries = _stacked([a["exact"] for a in asked], dim)
                low, step, codes = np.frombuffer(low), np.frombuffer(step), np.frombuffer(codes, np.uint8).reshape(-1, dim)
                columns = on_file(asked, queries, np.array(rows, np.int64), lambda at, q=queries, lo=low, st=step, co=codes: score_bounds(q, lo, st, co[at : at + CHUNK]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        return on_batch

    return map_batches(met, make, schema)


def _best_lower(k: int):
    """Of one file, each query's ``k`` best lower bounds."""

    def on_file(asked, queries, rows, bounds):
        best = np.full((len(queries), 0), -np.inf)
        for at in range(0, len(rows), CHUNK):
            best = np.concatenate([best, bounds(at)[0]], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        return np.repeat(np.array([a["row"] for a in asked], np.int64), best.shape[1]), best.ravel()

    return on_file


def _reaching(asked, queries, rows, bounds):
    """Of one file, the vectors whose upper bound reaches the query's floor."""
    ids, floor = np.array([a["row"] for a in asked], np.int64), np.array([a["floor"] for a in asked])
    out = []
    for at in range(0, len(rows), CHUNK):
        upper = bounds(at)[1]
        q, p = np.nonzero(upper >= floor[:, None])
        out.append((ids[q], rows[at + p], upper[q, p]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def order_key(score: int) -> str:
    """A string that sorts as the number does, of any size."""
    digits = f"{abs(score):x}"
    if score >= 0:
        return f"b{len(digits):04x}{digits}"
    return f"a{0xFFFF - len(digits):04x}" + "".join("fedcba9876543210"[int(c, 16)] for c in digits)


def _whole(x: float) -> int:
    return int(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE


def exact_score(q: np.ndarray, x: np.ndarray) -> int:
    """Integer inner product of two vectors as ``scaled``, whatever its size."""
    with np.errstate(over="ignore"):
        small = np.abs(q).max() * np.abs(x).max() * len(q) * SCALE * SCALE < 2.0**52
    if small:
        return int(q @ x * (SCALE * SCALE))
    return sum(_whole(a) * _whole(b) for a, b in zip(q.tolist(), x.tolist(), strict=True))


def _scored(pairs: DataFrame) -> DataFrame:
    """(query, row, near, exact, q_exact) to (query, row, score, key)."""

    def make():
        def on_batch(batch: pa.RecordBatch):
            scores = [exact_score(np.frombuffer(q), np.frombuffer(x)) for q, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            held = [min(max(s, -(2**63)), 2**63 - 1) for s in scores]
            near = [float(s) if abs(s) < 2**1000 else float("inf") if s > 0 else float("-inf") for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.int64()), pa.array(near, pa.float64()), pa.array(map(order_key, scores), pa.string())], ["query", "row", "score", "near", "key"])

        return on_batch

    return map_batches(pairs.select("query", "row", "q_exact", "exact"), make, "query long, row long, score long, near double, key string")


def candidates(spark: SparkSession, rows: DataFrame, asked: DataFrame, k: int, block: int, scratch: Scratch) -> DataFrame:
    """(query, row, upper, place): per distinct query vector the rows whose upper bound reaches its floor, by falling bound."""
    files = scratch.save(approximation_files(rows, block), "files")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    one = F.struct("row", "exact")
    blocks = asked.groupBy(group, "dim").agg(F.collect_list(one).alias("asked"))
    lower = _scan(files, blocks, _best_lower(k), "query long, lower double")
    by_lower = Window.partitionBy("query").orderBy(F.desc("lower"))
    floors = lower.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    floors = scratch.save(floors.select(F.col("query").alias("row"), "floor"), "floors")
    with_floor = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    blocks = with_floor.groupBy(group, "dim").agg(F.collect_list(F.struct("row", "exact", "floor")).alias("asked"))
    found = scratch.save(_scan(files, blocks, _reaching, "query long, row long, upper double"), "found")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    return scratch.save(found.withColumn("place", place), "candidates")


def top_k(spark: SparkSession, vectors: DataFrame, queries: str, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that meets the condition ``queries``, the ``k`` best other rows.

    Score is the integer inner product; ties go to the smaller vec_id (null last). Vectors that
    are null, empty, of another dimension than the query's, or hold null or non-finite components
    take no part; all others do, however large: the order is that of the exact score, and a score that a long
    can't hold is given as the largest (or smallest) long. Only the query's own row is left out, so a row
    repeated is a candidate; an empty table gives no rows.

    Of equal vectors only the ``k + 1`` smallest ids can be among the best, and equal query vectors are
    searched once, so copies add no work.
    """
    scratch = Scratch(spark, "topk")
    rows = integer_vectors(vectors, scratch)
    near = k + 1  # the query's own row may be among the best
    alike = Window.partitionBy("dim", "exact").orderBy(F.asc_nulls_last("vec_id"), "row")
    data = scratch.save(rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= near).drop("n"), "data")
    asking = rows.where(queries)
    asked = scratch.save(asking.groupBy("dim", "exact").agg(F.min("row").alias("row")), "asked")
    left = candidates(spark, data, asked, near, block, scratch)
    query = asked.select(F.col("row").alias("query"), F.col("exact").alias("q_exact"))
    exact = data.select("row", "vec_id", "exact")
    best, start, width, step = None, 0, FIRST * near, 0
    order = Window.partitionBy("query").orderBy(F.desc("key"), F.asc_nulls_last("vec_id"), "row")
    while True:
        batch = left.where((F.col("place") > start) & (F.col("place") <= start + width)).select("query", "row")
        got = _scored(batch.join(exact.drop("vec_id"), "row").join(query, "query")).join(exact.drop("exact"), "row")
        got = got if best is None else best.unionByName(got)
        best = scratch.save(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near).drop("rank"), f"best{step}")
        start, width, step = start + width, width * GROWTH, step + 1
        sure = best.groupBy("query").agg((F.min("near") / (SCALE * SCALE)).alias("kth"), F.count("*").alias("n")).where(F.col("n") == near)
        # a bound that only just misses by rounding still counts as reaching
        endless = float("inf")
        reach = F.col("kth").isNull() | (F.col("kth") == -endless) | (F.col("upper") == endless) | (F.col("upper") >= F.col("kth") - F.abs("kth") * ROUNDING)
        left = scratch.save(left.where(F.col("place") > start).join(sure.select("query", "kth"), "query", "left").where(reach).drop("kth"), f"left{step}")
        if left.isEmpty():
            break
    own = F.struct("row", "vec_id", "score")
    lists = best.withColumn("rank", F.row_number().over(order)).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", own.alias("hit")))).alias("hits"))
    answers = lists.join(query, "query").select("q_exact", "hits").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asking.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    # SALTS rows an answer, of which Spark's size of it counts one
    met = salted.join(answers.hint("merge"), (salted["exact"] == answers["q_exact"]) & (salted["salt"] == answers["salt"]))
    others = F.slice(F.filter("hits", lambda h: h["hit"]["row"] != F.col("row")), 1, k)
    found = met.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "h"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("h.hit.vec_id").alias("vec_id"), F.col("h.hit.score").alias("score"))


def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: query_id, rank, vec_id, score."""
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), f"vec_id % {EVERY} = 0")
