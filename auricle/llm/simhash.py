"""SimHash near-duplicates through one-wildcard segment variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, column_bytes, connected_components, fresh, map_batches

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
#: Texts that a Python worker holds at a time.
SLICE = 500
#: A variant bucket with more distinct fingerprints than this is joined on whole flipped fingerprints instead.
BUCKET_CAP = 64


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(b" ".join(words), HASH_SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[n - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    total = np.zeros(64, np.int64)
    for at in range(0, len(stops), 65536):
        hashes = np.array([digest(line[s:e], HASH_SEED) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(stops)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` columns other than the text, and ``fp`` long (the 64 bits as a signed number)."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    fields = [f for f in docs.schema.fields if f.name in rest]

    def make():
        def on_batch(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                values = np.array([fingerprint(x) for x in column_bytes(piece.column(piece.num_columns - 1))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(values, pa.int64())], [*rest, "fp"])

        return on_batch

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"])
    return map_batches(docs.select(*[docs[c] for c in rest], docs[text]), make, schema)


def variant_keys(fp: str = "fp") -> F.Column:
    """The 64 keys of a fingerprint: for either half and each bit of it, the half with that bit blanked.

    At two differing bits one half differs by at most one bit, so two such fingerprints
    share a key. A key packs the half's number, the blanked bit and the 31 bits left.
    """
    low, high = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(fp), 32)
    keys = []
    for half, bits in ((0, low), (1, high)):
        for i in range(32):
            keys.append(bits.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit((half * 32 + i) << 32)))
    return F.array(*keys)


def differing_bits(a: F.Column, b: F.Column) -> F.Column:
    return F.bit_count(a.bitwiseXOR(b))


def link_fingerprints(spark: SparkSession, prints: DataFrame, scratch: Scratch, cap: int = BUCKET_CAP) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column ``fp``, no repeats) at two or fewer differing bits.

    Fingerprints are equality-joined on their one-wildcard variants and verified. A variant
    shared by more than ``cap`` fingerprints would give quadratically many candidates; its
    members are joined on equal single-bit flips of the whole fingerprint instead (x and y
    differ by at most two bits if and only if x or a flip of x equals y or a flip of y), where
    no key can hold over 65 fingerprints. Fingerprints are dealt over all partitions before they become
    64 rows each, as the files they lie in are few. Spark sizes what an explode gives by the rows before it, so it would
    broadcast tables of 64 times that; the joins are hinted to merge sorted rows instead.
    """
    dealt = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = dealt.select("fp", F.explode(variant_keys()).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(keys.join(sizes.hint("merge"), "key"), "met")

    def pairs(rows: DataFrame) -> DataFrame:
        both = rows.select("key", F.col("fp").alias("a")).join(rows.select("key", F.col("fp").alias("b")).hint("merge"), "key")
        return both.where((F.col("a") < F.col("b")) & (differing_bits(F.col("a"), F.col("b")) <= MAX_BITS)).select("a", "b")

    crowded = met.where(F.col("n") > cap).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)])
    return pairs(met.where(F.col("n") <= cap)).unionByName(pairs(crowded.select("fp", F.explode(flips).alias("key")))).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cap: int = BUCKET_CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id (smallest doc_id reachable by links).

    Equal fingerprints are one node, so copies never become pairs. Null texts count as
    empty (fingerprint 0, linked like any other); a null doc_id is never a component's
    smallest id unless it has no other; repeated rows each give a row; an empty table gives none.
    """
    scratch = Scratch(spark, "simhash")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    marked = scratch.save(fingerprints(rows), "prints")
    nodes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = scratch.save(link_fingerprints(spark, nodes.select("fp"), scratch, cap), "links")
    roots = connected_components(spark, links, "a", "b")
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = scratch.save(joined.join(firsts, "root").select("fp", "root", "component_id"), "labels")
    return marked.join(labels, "fp").select("doc_id", "text_hash", "fp", "component_id", F.col("root").alias("group"))


def one_per_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) reduced to one row of each near-duplicate group.

    The row of smallest (doc_id, text hash) stays, nulls last; of rows repeated in full, one.
    """
    found = near_duplicates(spark, docs)
    keys = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = keys.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("best"))
    keep = Scratch(spark, "simhash-keep").save(best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"), F.col("best.n").alias("n")), "keep")
    own_hash, nth = fresh(docs, "hash"), fresh(docs, "nth")
    marked = docs.withColumn(own_hash, F.xxhash64("text"))

    def among(rows: DataFrame) -> DataFrame:
        return marked.join(rows, marked["doc_id"].eqNullSafe(rows["keep_id"]) & (marked[own_hash] == rows["keep_hash"]), "left_semi")

    repeated = keep.where("n > 1")
    if repeated.isEmpty():
        return among(keep).select(*docs.columns)
    order = Window.partitionBy("doc_id", own_hash).orderBy(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(1))
    first = among(repeated).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return among(keep.where("n = 1")).select(*docs.columns).unionByName(first.select(*docs.columns))


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, fingerprint as 16 hex digits, component_id."""
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
