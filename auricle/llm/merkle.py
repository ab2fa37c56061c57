"""Merkle manifest of a dataset: leaf hashes, roots per group and of all, and a proof for every row.

Leaves are ordered by range, so each knows its place in its group. Aligned runs of 2^HEIGHT leaves are blocks, each
one complete subtree in a van Emde Boas layout: the tree is cut at half its height, the top part is stored first and
the parts below it after, each in the same way, so a path from leaf to root touches few stretches of memory
at any block size. Block roots are the leaves of the next level, until a group has one root; the groups'
roots form a tree likewise. Proofs come down the same levels: each block hands its roots' path on to the blocks below.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, map_batches

#: Height of a block: it holds 2^HEIGHT leaves at most.
HEIGHT = 10
#: Blocks that a task unpacks at a time.
SLICE = 16
DIGEST = 32

#: Of a path: where the sibling is, one character a level (n: there is none), and the siblings' digests, 32 bytes each.
PATH = "sides string, siblings binary"


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the parts' hexadecimal texts, one after the other."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Where a complete binary tree of so many levels keeps its nodes: one array a depth, from the root down.

    The top half of the levels comes first, then the trees below it from left to right, all laid out by the same rule.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    upper, lower = addresses(top), addresses(levels - top)
    first, size = (1 << top) - 1, (1 << (levels - top)) - 1
    below = tuple((first + size * np.arange(1 << top)[:, None] + at[None, :]).ravel() for at in lower)
    return upper + below


class Subtree:
    """A block's tree in van Emde Boas layout over ``n`` leaves and ``height`` levels above them."""

    def __init__(self, n: int, height: int, data: bytes | bytearray) -> None:
        self.n, self.height, self.data = n, height, data
        self.where = addresses(height + 1)

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Subtree:
        """Every two nodes next to each other, or a last one alone, become their hash."""
        tree = cls(len(leaves), height, bytearray(((2 << height) - 1) * DIGEST))
        nodes = leaves
        for level in range(height + 1):
            if level:
                nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            for at, node in zip(tree.where[height - level].tolist(), nodes):  # the last nodes may be absent
                tree.data[at * DIGEST : (at + 1) * DIGEST] = node
        return tree

    def node(self, level: int, i: int) -> bytes:
        at = int(self.where[self.height - level][i]) * DIGEST
        return bytes(self.data[at : at + DIGEST])

    def root(self) -> bytes:
        return self.node(self.height, 0)

    def path(self, leaf: int) -> tuple[str, bytes]:
        """Sides and siblings from a leaf to the block's root."""
        sides, siblings, width = [], [], self.n
        for level in range(self.height):
            sibling = leaf ^ 1
            if sibling < width:
                sides.append("l" if sibling < leaf else "r")
                siblings.append(self.node(level, sibling))
            else:
                sides.append("n")
            leaf >>= 1
            width = (width + 1) >> 1
        return "".join(sides), b"".join(siblings)


def fold(node: bytes, sides: str, siblings: bytes) -> bytes:
    """The root that a leaf and its path give."""
    at = 0
    for side in sides:
        if side == "n":
            node = digest(node)
            continue
        sibling = siblings[at : at + DIGEST]
        at += DIGEST
        node = digest(sibling, node) if side == "l" else digest(node, sibling)
    return node


def field(value: Column, text: Column | None = None) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string") if text is None else text
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    """Leaf of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def places(spark: SparkSession, rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos`` (place in the group by ``order``) and ``n`` (rows of the group).

    Rows are sorted by range over all groups, counted by range and group, and each range starts where those before it end; only counts meet in one
    task. Rows that tie are dealt over ranges by a number of their own, so a third of all rows may be equal.
    """
    tie = F.monotonically_increasing_id()
    keyed = rows.withColumn("tie", tie)
    keys = [F.asc_nulls_first(c) for c in (group, *order, "tie")]
    names, fields = rows.columns, rows.schema.fields
    at = names.index(group)

    def make():
        part, last, count = TaskContext.get().partitionId(), object(), 0

        def on_batch(batch: pa.RecordBatch):
            nonlocal last, count
            own = []
            for value in batch.column(at).to_pylist():
                if value != last:
                    last, count = value, 0
                own.append(count)
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(own, pa.int64())], [*names, "part", "own"])

        return on_batch

    sorted_rows = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*rows.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "part int, own long"])
    counted = scratch.save(map_batches(sorted_rows, make, schema), "sorted")
    sizes = counted.groupBy("part", group).agg(F.count("*").alias("size"))
    over = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("part").alias("start_part"), F.col(group).alias("start_group"), before.alias("before"), F.sum("size").over(over).alias("n"))
    joined = counted.join(starts, (counted["part"] == starts["start_part"]) & counted[group].eqNullSafe(starts["start_group"]))
    return joined.select(*rows.columns, (F.col("own") + F.col("before")).alias("pos"), "n")


def blocks_of(rows: DataFrame, height: int) -> DataFrame:
    """(grp, block, n, leaves, extra): aligned runs of rows (grp, pos, n, leaf, extra), a row a block. A block has 2^height leaves at most."""
    one = F.struct("pos", "leaf", "extra")
    runs = rows.groupBy("grp", F.shiftright("pos", height).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(one)).alias("rows"))
    return runs.select("grp", "block", "n", F.col("rows.leaf").alias("leaves"), F.col("rows.extra").alias("extra"))


def block_height(n: int, height: int) -> int:
    """Levels that a block climbs in a group of ``n`` nodes: all of them, or to the group's root if it is the only block."""
    return height if n > 1 << height else (n - 1).bit_length()


def with_trees(blocks: DataFrame, height: int) -> DataFrame:
    """``blocks`` with ``tree`` (the block in van Emde Boas layout) and ``root``."""
    kind = dict(blocks.dtypes)
    names = ["grp", "block", "n", "leaves", "extra", "tree", "root"]

    def make():
        def on_batch(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                trees = [Subtree.build(x, block_height(n, height)) for x, n in zip(piece.column(3).to_pylist(), piece.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([bytes(t.data) for t in trees], pa.binary()), pa.array([t.root() for t in trees], pa.binary())], names)

        return on_batch

    return map_batches(blocks, make, f"grp {kind['grp']}, block long, n long, leaves array<binary>, extra {kind['extra']}, tree binary, root binary")


class Manifest:
    """Trees of all groups: ``levels`` of blocks, the rows' own first, and ``roots`` (grp, leaf, extra), a row a group."""

    def __init__(self, spark: SparkSession, rows: DataFrame, scratch: Scratch, name: str, height: int = HEIGHT) -> None:
        """``rows`` have grp, pos (from 0 without gaps in a group), n (rows of the group), leaf and extra (any struct)."""
        self.height = height
        self.levels: list[DataFrame] = []
        now = rows
        while True:
            level = scratch.save(with_trees(blocks_of(now, height), height), f"{name}-{len(self.levels)}", "zstd")
            self.levels.append(level)
            n = F.ceil(F.col("n") / (1 << height)).cast("long")
            now = level.select("grp", F.col("block").alias("pos"), n.alias("n"), F.col("root").alias("leaf"), F.struct(F.lit(0).alias("none")).alias("extra"))
            if now.where("n > 1").isEmpty():
                break
        self.roots = now.select("grp", "leaf", "extra")

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, leaf, extra, sides, siblings) of every row, ``above`` being what leads from each group's root on: (grp, sides, siblings, top).

        Columns ``subroot`` and ``top`` are handed down with it.
        """
        now = above.withColumn("block", F.lit(0).cast("long"))
        for depth, level in reversed(list(enumerate(self.levels))):
            here = now.select(F.col("grp").alias("up_grp"), F.col("block").alias("up_block"), "sides", "siblings", "subroot", "top")
            joined = level.join(here, level["grp"].eqNullSafe(here["up_grp"]) & (level["block"] == here["up_block"])).drop("up_grp", "up_block")
            now = self._descend(joined, depth == 0)
        return now

    def _descend(self, blocks: DataFrame, last: bool) -> DataFrame:
        height, kind = self.height, dict(blocks.dtypes)
        extra = kind["extra"].removeprefix("array<")[:-1]
        rows = blocks.select("grp", "block", "n", "leaves", "extra", "tree", "sides", "siblings", "subroot", "top")
        names = ["grp", "block", "leaf", "extra", "sides", "siblings", "subroot", "top"]

        def make():
            def on_batch(batch: pa.RecordBatch):
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    get = lambda c: row.column(c)[0].as_py()  # noqa: B023, E731
                    block, leaves = get(1), row.column(3).flatten()
                    size = len(leaves)
                    tree = Subtree(size, block_height(get(2), height), get(5))
                    sides, siblings = get(6), get(7)
                    own = [tree.path(p) for p in range(size)]
                    repeat = lambda c: row.column(c).take(pa.array(np.zeros(size, np.int64)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [
                            repeat(0), pa.array(np.arange(size, dtype=np.int64) + (block << height)), leaves, row.column(4).flatten(),
                            pa.array([s + sides for s, _ in own]), pa.array([s + siblings for _, s in own], pa.binary()), repeat(8), repeat(9),
                        ],
                        names,
                    )

            return on_batch

        return map_batches(rows, make, f"grp {kind['grp']}, block long, leaf binary, extra {extra}, {PATH}, subroot binary, top binary")


def prove(spark: SparkSession, rows: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """(grp, leaf, extra, sides, siblings, subroot, top) of ``rows`` (the group's column, those of ``order``, leaf binary, extra).

    Groups ascend bytewise, null first. A group of any size is spread over ranges and blocks; groups may be many. An empty table gives no rows.
    """
    scratch = Scratch(spark, "merkle")
    placed = places(spark, rows, group, [*order, "leaf"], scratch).select(F.col(group).alias("grp"), "pos", "n", "leaf", "extra")
    groups = Manifest(spark, placed, scratch, "rows", height)
    listed = groups.roots.select(F.lit(0).alias("one"), F.col("grp").alias("name"), "leaf")
    tops = places(spark, listed, "one", ["name"], Scratch(spark, "merkle-groups"))
    forest = Manifest(spark, tops.select(F.col("one").alias("grp"), "pos", "n", "leaf", F.struct("name").alias("extra")), scratch, "groups", height)
    root = forest.roots.select("grp", F.lit("").alias("sides"), F.lit(b"").alias("siblings"), F.col("leaf").alias("subroot"), F.col("leaf").alias("top"))
    above = forest.paths(root).select(F.col("extra.name").alias("grp"), "sides", "siblings", F.col("leaf").alias("subroot"), "top")
    return groups.paths(above)


def folded(paths: DataFrame, leaf: Column, name: str) -> DataFrame:
    """``paths`` with the root that ``leaf`` and each path give."""
    rows = paths.withColumn(name, leaf)
    names = rows.columns
    at = {c: i for i, c in enumerate(names)}
    kinds = dict(paths.dtypes)

    def make():
        def on_batch(batch: pa.RecordBatch):
            columns = (batch.column(at[c]).to_pylist() for c in (name, "sides", "siblings"))
            found = [fold(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at[name]], pa.array(found, pa.binary())], names)

        return on_batch

    return map_batches(rows, make, ", ".join([*(f"`{c}` {kinds[c]}" for c in paths.columns), f"{name} binary"]))


def manifest(spark: SparkSession, docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaf, roots and proof of every row of documents: doc_id, lang, leaf, subroot, root, sides, siblings, folded, all digests as bytes.

    A leaf hashes doc_id, source, lang, n_chars and text, null or not. Leaves ascend by doc_id in their lang, null first, rows of
    one id by their hashes; rows repeated in full have equal leaves and a place each. ``folded`` is the root that the row's leaf gives with its siblings, where every seventh
    row by the hash of its id has a wrong n_chars, if any; null ids are never tampered with. Texts of any length are hashed whole in Spark;
    further columns are not read; an empty table gives no rows.
    """
    fields = [docs[c] for c in ("doc_id", "source", "lang")]
    wrong = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    tampered = F.when(wrong & docs["n_chars"].isNotNull(), leaf_hash(*fields, docs["n_chars"].cast("decimal(20,0)") + 1, docs["text"]))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].alias("lang"), leaf_hash(*fields, docs["n_chars"], docs["text"]).alias("leaf"), tampered.alias("tampered"))
    hashed = Scratch(spark, "merkle-leaves").save(rows.select("lang", "doc_id", "leaf", F.struct("doc_id", "tampered").alias("extra")), "leaves")
    proofs = prove(spark, hashed, "lang", ["doc_id"], height)
    checked = folded(proofs, F.coalesce("extra.tampered", "leaf"), "folded")
    return checked.select("extra.doc_id", F.col("grp").alias("lang"), "leaf", "subroot", F.col("top").alias("root"), "sides", "siblings", "folded")


def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = manifest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("siblings"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
