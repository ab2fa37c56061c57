"""Embedding near-duplicates: an exact metric range join over nested pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, connected_components, map_batches

COSINE = 0.98
#: A cell is split by one pivot in BLOCK vectors, but by so many at least and at most.
MIN_PIVOTS, MAX_PIVOTS = 4, 16
#: Vectors of a label from which it has pivots, and of a cell from which it is split again.
SPLIT = 16
#: Cells are split and compared in blocks of about so many vectors.
BLOCK = 2048
#: A further split that leaves more copies a vector than this is given up, as it costs more than it prunes.
MAX_COPIES = 2.0
CELL = ("label", "dim", "cell")


def distinct_vectors(spark: SparkSession, vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """One row (class_id, label, embedding, members, first) per distinct usable vector of a label; all else links with nothing."""
    usable = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    rows = vectors.where(usable).groupBy("label", "embedding").agg(F.count("*").alias("members"), F.min("vec_id").alias("first"))
    return scratch.save(rows.withColumn("class_id", F.monotonically_increasing_id()), "classes")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe from overflow."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def placed_in_labels(classes: DataFrame) -> DataFrame:
    """(label, dim, cell, class_id, members, away, unit): each vector in its label's one cell, scaled to length one."""
    kind = classes.schema["label"].dataType.simpleString()

    def make():
        def on_batch(batch: pa.RecordBatch):
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            units = [unit(flat[None, e - n : e])[0].tobytes() for e, n in zip(ends, sizes, strict=True)]
            n = batch.num_rows
            columns = [batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(["0"] * n), batch.column(0), batch.column(2), pa.array(np.zeros(n, np.int32)), pa.array(units, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*CELL, "class_id", "members", "away", "unit"])

        return on_batch

    return map_batches(classes.select("class_id", "label", "members", "embedding"), make, f"label {kind}, dim int, cell string, class_id long, members long, away int, unit binary")


def _matrix(units: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in units.to_pylist()])


def _split_block(rows: pa.Table, pivots: pa.Table, reach: float, level: int) -> pa.Table:
    """A block of a cell's rows, each in the cell of its nearest pivot, and in those of earlier pivots that its neighbours may be in.

    A neighbour within ``reach`` that is nearest to pivot j has distances to j and to this vector's
    pivot i that differ from this vector's by at most ``reach`` each, so by the triangle inequality
    d(x, j) <= d(x, i) + 2 * reach; the distance to the plane midway between the pivots bounds it again.
    Of two neighbours in cells j < i the one in i goes to j as well, marked as away there, so each pair
    that may be linked meets in one cell of a level where not both are away.
    """
    if not rows.num_rows:  # of a small cell, no row fell to this block
        return pa.table({**{c: rows.column(c) for c in (*CELL, "class_id", "members", "away", "unit")}, "parent": rows.column("cell")})
    by_order = np.lexsort((pivots.column("pivot_id").to_numpy(), pivots.column("order").to_numpy()))
    x, p = _matrix(rows.column("unit")), _matrix(pivots.column("pivot"))[by_order]
    square = np.maximum(2 - 2 * x @ p.T, 0)
    near, d = square.argmin(axis=1), np.sqrt(square)
    own = np.arange(len(x))
    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[near]
    copies = d <= d[own, near][:, None] + 2 * reach
    copies &= square - square[own, near][:, None] <= 2 * reach * apart + 1e-9
    copies &= np.arange(len(p))[None, :] < near[:, None]
    copies[own, near] = True
    at, to = np.nonzero(copies)
    out = rows.select([*CELL, "class_id", "members", "away", "unit"]).take(pa.array(at))
    parent = out.column("cell")
    cell = pa.array([f"{c}.{j}" for c, j in zip(parent.to_pylist(), to.tolist(), strict=True)])
    away = out.column("away").to_numpy() | ((to != near[at]).astype(np.int32) << level)
    out = out.set_column(out.schema.get_field_index("cell"), "cell", cell)
    return out.set_column(out.schema.get_field_index("away"), "away", pa.array(away.astype(np.int32))).append_column("parent", parent)


def _splitter(reach: float, level: int):
    return lambda rows, pivots: _split_block(rows, pivots, reach, level)


def _dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` of the cells of ``sizes`` (n), with n, the number of blocks of the cell, and the row's block."""
    return rows.join(sizes.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")), list(CELL)).withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))


def cells(classes: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """(label, dim, cell, class_id, members, away, unit): the vectors in cells around pivots, nested until cells are small.

    Pivots are drawn by hash in each cell and travel with its blocks, so their number grows with the
    data and nothing of it passes the driver. Splitting a cell again is given up where it leaves more than MAX_COPIES
    copies a vector; such cells are compared block by block.
    """
    now, settled, level = scratch.save(placed_in_labels(classes), "level0"), [], 0
    kind = now.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, cell string, class_id long, members long, away int, unit binary, parent string"
    while True:
        sizes = now.groupBy(*CELL).agg(F.count("*").alias("n"))
        large = scratch.save(sizes.where(F.col("n") >= (SPLIT if level == 0 else BLOCK + 1)), f"large{level}")
        if level == 30 or large.isEmpty():
            break
        settled.append(now.join(large.select(*CELL), list(CELL), "left_anti"))
        dealt = _dealt(now, large)
        order = F.xxhash64("class_id", F.lit(level))
        wanted = F.least(F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(MIN_PIVOTS)), F.lit(MAX_PIVOTS))
        drawn = now.withColumn("order", order).withColumn("place", F.row_number().over(Window.partitionBy(*CELL).orderBy("order", "class_id"))).where(F.col("place") <= MAX_PIVOTS)
        drawn = drawn.select(*CELL, "order", F.col("class_id").alias("pivot_id"), F.col("unit").alias("pivot"), "place")
        drawn = drawn.join(large.withColumn("wanted", wanted), list(CELL)).where(F.col("place") <= F.col("wanted"))
        drawn = scratch.save(drawn, f"pivots{level}").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1))).select(*CELL, "part", "order", "pivot_id", "pivot")
        keys = [*CELL, "part"]
        split = dealt.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(_splitter(reach, level), schema)
        split = scratch.save(split, f"split{level}")
        parent = [F.col("label"), F.col("dim"), F.col("parent").alias("cell")]
        copies = split.groupBy(*parent).agg(F.count("*").alias("copies")).join(large, list(CELL))
        most = MAX_COPIES if level else float(MAX_PIVOTS)
        kept = scratch.save(copies.where(F.col("copies") <= F.col("n") * most).select(*CELL), f"kept{level}")
        settled.append(dealt.join(kept, list(CELL), "left_anti").select(*now.columns))
        now = scratch.save(split.join(kept.withColumnRenamed("cell", "parent"), ["label", "dim", "parent"]).select(*now.columns), f"level{level + 1}")
        level += 1
    for part in settled:
        now = now.unionByName(part)
    return scratch.save(now, "placed")


def _links_of_block(table: pa.Table, cosine: float) -> pa.Table:
    """Links between two blocks of a cell: how many vectors each row links with, and edges that span the linked ones."""
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    part = table.column("part").to_numpy()
    ids, members, away = table.column("class_id").to_numpy(), table.column("members").to_numpy(), table.column("away").to_numpy()
    x = _matrix(table.column("unit"))
    left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
    linked = x[left] @ x[right].T >= cosine
    # a pair away on one level meets again in the cell that one of the two is at home in
    linked &= away[left][:, None] & away[right][None, :] == 0
    if a == b:
        np.fill_diagonal(linked, False)
    counts = np.zeros(len(ids), np.int64)
    counts[left] = linked @ members[right]
    if a != b:
        counts[right] = members[left] @ linked
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    root = ids.copy()
    while len(i):  # smallest id among linked rows, until nothing changes
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            break
    touched = np.zeros(len(ids), bool)
    touched[i], touched[j] = True, True
    return pa.table({"class_id": ids[touched], "links": counts[touched], "root": root[touched]})


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Equal vectors of a label are one row of the join, with their number. Cells join on their own;
    a cell of over BLOCK rows is dealt into blocks and compared block by block, so no task
    grows with a cell. Vectors of unequal dimension are not compared. Rows without label, and vectors that
    are null, empty, zero or hold null or non-finite components, link with nothing and are their own component. A repeated row
    is another vector. A null vec_id is never a component's smallest unless there is no other. An empty table gives no rows; other columns are not looked at.
    """
    scratch = Scratch(spark, "nearvec")
    classes = distinct_vectors(spark, vectors, scratch)
    reach = math.sqrt(2 - 2 * cosine) + 1e-6
    placed = cells(classes, reach, scratch)
    dealt = _dealt(placed, placed.groupBy(*CELL).agg(F.count("*").alias("n")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other", "parts", "n")
    found = scratch.save(pairs.groupBy(*CELL, "a", "b").applyInArrow(lambda t: _links_of_block(t, cosine), "class_id long, links long, root long"), "found")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = connected_components(spark, found.select("class_id", "root"), "class_id", "root")
    joined = classes.join(links, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component"))
    labelled = scratch.save(joined.join(firsts, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), "component"), "labelled")
    rows = vectors.select("vec_id", "embedding", "label").join(labelled, ["label", "embedding"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def near_vector_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: vec_id, n_links, component_id, kept."""
    return near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
