"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import WORD, Scratch

BUDGET = 1.5
MAX_EPOCHS = 2
WEIGHTS = (3, 1, 2)
#: Hex digits of the draw looked at in one step of the threshold search: 256 cells.
DIGITS = 2
STEPS = 3


def source_key(source: str = "source") -> Column:
    """A string that orders like the source by code point, and a null source last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """Seeded random hex string of a row; rows equal in doc_id and text draw alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def running_before(rows: DataFrame, by: tuple[str, ...], sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with the sums of all rows before each one in the order of ``by``, without a window over all rows.

    Rows are cut into sorted ranges, one a partition; each range runs its own sums from the totals of
    the ranges before it. Only those totals, a row a range, meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(rows.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()), name)
    first, inside = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    offsets = totals.select("range", *[F.coalesce(F.sum(n).over(first), F.lit(0)).alias(f"{n}_of_ranges") for n in sums])
    joined = placed.join(offsets, "range")
    return joined.select(*rows.columns, *[(F.col(f"{n}_of_ranges") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def repeating_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(key, size) with ``weight``: the given weights repeat over the keys in order."""
    numbered = running_before(sources, ("key",), {"at": F.lit(1)}, Scratch(sources.sparkSession, "weights"), "keys")
    return numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")).drop("at")


def water_filling(weighted: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(key, size, weight) with ``target`` double.

    Shares of ``budget`` times all sizes go by weight; a source over ``max_epochs`` times its
    size is clamped there and the excess is shared by weight among the others, until none
    is above. The fixed point is one water level: with sources in order of capacity per
    weight, those before the first that its level leaves room for are the clamped ones.
    Without any feasible level every source is clamped. Of the sources only two sums and the level come to the driver.
    """
    scratch = Scratch(weighted.sparkSession, "water")
    rows = weighted.withColumn("cap", (F.col("size") * max_epochs).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    rows = scratch.save(running_before(rows, ("fill", "key"), {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, scratch, "sorted"), "before")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(total["size"] * float(budget)) - F.col("cap_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    found = rows.withColumn("level", level).where(F.col("cap") > F.col("weight") * F.col("level")).orderBy("fill", "key").select("level").first()
    target = F.least("cap", F.col("weight") * found["level"]) if found else F.col("cap")
    return rows.select("key", "size", "weight", target.alias("target"))


def repetition_plan(spark: SparkSession, sizes: DataFrame, targets: DataFrame, scratch: Scratch, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per source: key, size, target, ``whole`` repetitions, and ``cut``: rows whose draw is up to it are taken once more.

    ``sizes`` has key, n (words) and u (draw). The rows in order of their draw are taken while
    half a row or less lies beyond the words wanted, so a source misses its target by half a
    document at most. The cut is searched digit by digit: words are summed by source and the next digits of
    the draw (256 cells, partial sums first), the cell in which the words run out is kept,
    and only its rows are looked at again. No step gathers a source's rows.
    """
    size, target = F.col("size"), F.col("target")
    whole = F.when(size > 0, F.least(F.floor(target / size), F.floor(F.lit(float(max_epochs))))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("whole", whole).withColumn("want", target - F.col("whole") * size)
    left, prefix = sizes, plan.select("key", "want").where("want > 0").withColumn("start", F.lit(""))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    for step in range(STEPS):
        width = (step + 1) * DIGITS
        left = left.join(prefix.select("key", "start"), "key").where(F.col("u").startswith(F.col("start"))).select("key", "n", "u")
        cells = left.groupBy("key", F.substring("u", 1, width).alias("cell")).agg(F.sum("n").alias("words"))
        cells = cells.join(prefix.select("key", "want"), "key").withColumn("sofar", F.coalesce(F.sum("words").over(before), F.lit(0)))
        hit = cells.where((F.col("sofar") <= F.col("want")) & (F.col("want") < F.col("sofar") + F.col("words")))
        prefix = scratch.save(hit.select("key", (F.col("want") - F.col("sofar")).alias("want"), F.col("cell").alias("start")), f"step{step}")
    left = left.join(prefix, "key").where(F.col("u").startswith(F.col("start")))
    last = left.groupBy("key", "start", "want", F.col("u").alias("cell")).agg(F.sum("n").alias("words")).withColumn("sofar", F.coalesce(F.sum("words").over(before), F.lit(0)))
    taken = F.max(F.when(F.col("sofar") * 2 + F.col("words") <= F.col("want") * 2, F.col("cell")))
    cuts = last.groupBy("key").agg(taken.alias("cut"), F.min("start").alias("start"))
    # without a row of the last cell, all draws before the cell
    plan = plan.join(cuts, "key", "left").withColumn("cut", F.when(F.col("want") > 0, F.coalesce("cut", "start", F.lit("g"))).otherwise(F.lit("")))
    return scratch.save(plan.select("key", "size", "target", "whole", "cut"), "plan")


def plan_mix(spark: SparkSession, docs: DataFrame, weigh=repeating_weights, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """The repetition plan of ``docs`` (doc_id, text, source); ``weigh`` adds weight to (key, size)."""
    if max_epochs <= 0:
        raise ValueError("max_epochs must be above 0")
    scratch = Scratch(spark, "mix")
    sizes = scratch.save(docs.select(source_key().alias("key"), word_count().alias("n"), draw(seed).alias("u")), "sizes")
    targets = scratch.save(water_filling(weigh(sizes.groupBy("key").agg(F.sum("n").alias("size"))), budget, max_epochs), "targets")
    return repetition_plan(spark, sizes, targets, scratch, max_epochs)


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """(doc, size, source_size, target, copies), ``doc`` being a struct of a row's columns (all, or those to ``keep``).

    The plan has a row per source; Spark picks the join by its size.
    """
    keyed = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), source_key().alias("key"), word_count().alias("words"), draw(seed).alias("u"))
    copies = (F.col("whole") + (F.col("u") <= F.col("cut")).cast("int")).alias("copies")
    return keyed.join(plan, "key").select("doc", F.col("words").alias("size"), F.col("size").alias("source_size"), "target", copies)


def mix_documents(spark: SparkSession, docs: DataFrame, weigh=repeating_weights, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """``docs`` mixed: each row as often as the plan takes it, from not at all to ``max_epochs`` times.

    ``max_epochs`` is any number above 0. Other columns stay as they are, whatever their names. Null texts have no words and are repeated like any; null sources form one source, the last;
    rows equal in doc_id and text are taken alike; an empty table stays empty.
    """
    planned = with_copies(docs, plan_mix(spark, docs, weigh, budget, max_epochs, seed), seed)
    return planned.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, size, source_size, target, taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    planned = with_copies(docs, plan_mix(spark, docs), keep=["doc_id"])
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS u
  FROM documents),
s AS (
  SELECT key, sum(size)::BIGINT AS source_size,
    ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY key),
f AS (SELECT *, (source_size * 2)::DOUBLE AS cap, (source_size * 2)::DOUBLE / weight AS fill FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, coalesce(least(cap, weight * (SELECT arg_min(level, (fill, key)) FROM l WHERE cap > weight * level)), cap) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
r AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS want, u, d.key,
    sum(size) OVER (PARTITION BY d.key ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.key, u) AS tied
  FROM d JOIN p ON d.key = p.key)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN 2 * upto - tied <= 2 * want AND want > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
