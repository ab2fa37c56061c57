"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.llm.common import Scratch, column_bytes, map_batches

#: Bounds of the sample that the classifier is fitted on: documents confirmed toxic, unlabelled text, words. They bound
#: what reaches the driver: at most (MAX_POSITIVE + MAX_UNLABELLED) * MAX_WORDS pairs of numbers, in practice far fewer.
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 9_000
MAX_WORDS = 20_000
#: Texts that a Python worker holds at a time.
SLICE = 500
#: A word is a feature if this many sampled documents have it and its count among the confirmed ones lies this many standard errors off chance.
MIN_DOCUMENTS = 10
MIN_ERRORS = 5.0
THRESHOLD = 0.7
MEMO = 1_000_000
EDGES = re.compile(rb"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")


def word_hash(word: bytes) -> int:
    """Hash of a word without outer ASCII punctuation, A-Z lower-cased."""
    return xxhash.xxh64_intdigest(EDGES.sub(b"", word).lower())


@dataclass(frozen=True)
class Classifier:
    """Linear model over the words a text holds: sorted word hashes, their weights and a bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = dict(zip(self.hashes.tolist(), enumerate(self.weights.tolist()), strict=True))
        memo: dict[bytes, tuple[int, float] | None] = {}

        def score(text: bytes | None) -> float:
            found = {}
            for word in set((text or b"").split()):
                if word in memo:
                    hit = memo[word]
                else:
                    if len(memo) >= MEMO:
                        memo.clear()
                    hit = memo[word] = table.get(word_hash(word))
                if hit is not None:
                    found[hit[0]] = hit[1]
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(found[k] for k in sorted(found)), -50, 50))))

        return score


@dataclass(frozen=True)
class Sample:
    """Which words (columns) each text (row) holds, which texts are confirmed positive, and the class priors.

    ``prior`` is the share of positives among all texts, ``hidden`` that among unlabelled ones, and
    ``weight`` the share of unlabelled ones among all.
    """

    rows: np.ndarray
    columns: np.ndarray
    n_columns: int
    positive: np.ndarray
    prior: float
    hidden: float
    weight: float


def risk_parts(x: Sample, w: np.ndarray, b: float) -> tuple[float, float]:
    """(prior * R_p+, weight * (R_u- - hidden * R_p-)) with logistic loss: what positives cost as positives, and what
    unlabelled rows cost as negatives less the positives hidden among them."""
    z = np.clip(b + np.bincount(x.rows, weights=w[x.columns], minlength=len(x.positive)), -50, 50)
    n_pos, n_un = max(1, x.positive.sum()), max(1, (~x.positive).sum())
    as_negative = np.logaddexp(0, z)
    free = as_negative[~x.positive].sum() / n_un - x.hidden * as_negative[x.positive].sum() / n_pos
    return x.prior * np.logaddexp(0, -z)[x.positive].sum() / n_pos, x.weight * free


def risk_gradient(x: Sample, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The step's direction: the gradient of the sum of both parts, or, where the second is below zero, of its negative alone."""
    z = np.clip(b + np.bincount(x.rows, weights=w[x.columns], minlength=len(x.positive)), -50, 50)
    p = 1 / (1 + np.exp(-z))
    n_pos, n_un = max(1, x.positive.sum()), max(1, (~x.positive).sum())
    negative = x.weight * np.where(x.positive, -x.hidden * p / n_pos, p / n_un)
    g = np.where(x.positive, x.prior * (p - 1) / n_pos, 0) + negative if risk_parts(x, w, b)[1] >= 0 else -negative
    return np.bincount(x.columns, weights=g[x.rows], minlength=x.n_columns), float(g.sum())


def fit_nnpu(x: Sample, epochs: int = 300, rate: float = 0.05, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, prior * R_p+ + max(0, weight * (R_u- - hidden * R_p-)), by Adam steps.

    Where the second part falls below zero the step is turned round to bring it back.
    """
    w, b = np.zeros(x.n_columns), float(np.log(x.prior / (1 - x.prior)))
    m, v, mb, vb = np.zeros(x.n_columns), np.zeros(x.n_columns), 0.0, 0.0
    for step in range(1, epochs + 1):
        gw, gb = risk_gradient(x, w, b)
        gw = gw + penalty * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return w, b


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from: crc32(doc_id as text) mod 3 is 1 (null ids are not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def smallest_draws(rows: DataFrame, seed: str, most: int) -> DataFrame:
    """At most ``most`` rows (of a column doc_id), those of smallest hash; a first cut by the hash keeps the sort small."""
    draw = F.xxhash64("doc_id", F.lit(seed))
    n = rows.count()
    share = min(1.0, (2 * most + 100) / max(1, n))
    return rows.where(F.pmod(draw, F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(F.pmod(draw, F.lit(1 << 40)), "doc_id").limit(most)


def _word_sets(docs: DataFrame) -> DataFrame:
    """(positive, text) to (positive, words array<long>)."""

    def make():
        def on_batch(batch: pa.RecordBatch):
            found = [np.unique(np.array([word_hash(w) for w in set((x or b"").split())], np.uint64)).view(np.int64) for x in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["positive", "words"])

        return on_batch

    return map_batches(docs, make, "positive boolean, words array<long>")


def telling_words(sample: DataFrame, n: int, n_positive: int, most: int) -> DataFrame:
    """(word, at): the ``most`` words whose share of confirmed texts lies farthest off chance, numbered from 0."""
    counts = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if("positive").alias("among"))
    share = n_positive / n
    errors = F.abs(F.col("among") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    kept = counts.where(F.col("n") >= MIN_DOCUMENTS).withColumn("errors", errors).where(F.col("errors") >= MIN_ERRORS).orderBy(F.desc("errors"), "word").limit(most)
    return kept.withColumn("at", F.row_number().over(Window.orderBy("word")) - 1).select("word", "at")  # at most ``most`` rows


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> Classifier:
    """Fit on confirmed toxic documents against unlabelled text: a sample of all other documents outside the held-out fold, in any table of labels or not.

    Both samples are the rows of smallest hash, at most ``max_positive`` and
    ``max_unlabelled`` of them. The class prior is the share of
    toxic rows among all labelled ones outside the fold and twice its standard error, as a prior too small makes
    hidden positives count as negatives, while the risk's floor at zero guards against one too large. What of it is not confirmed is hidden among the others. Null or repeated labels: an id counts once, as
    toxic if any of its rows says so; null ids and null labels are not used. A text counts once in each sample, repeated or not.
    Without any confirmed document, or any document, the classifier gives every text the score 0.
    """
    scratch = Scratch(spark, "toxicity")
    none = Classifier(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not labelled["toxic"]:
        return none
    share = labelled["toxic"] / labelled["n"]
    share = min(0.9999, share + 2 * np.sqrt(share * (1 - share) / labelled["n"]))
    toxic = smallest_draws(known.where("toxic = 1").select("doc_id"), "confirmed", max_positive)
    # the limits after the joins hold for ids that recur in ``docs``
    own = docs.select(F.col("doc_id").alias("own_id"), "text")
    positive = own.join(F.broadcast(toxic), F.col("own_id") == toxic["doc_id"], "left_semi").distinct().limit(max_positive)
    free = scratch.save(docs.where("doc_id is not null").where(~held_out()).select("doc_id"), "free")
    others = scratch.save(free.join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_anti"), "others")
    drawn = smallest_draws(others, "unlabelled", max_unlabelled).distinct()
    unlabelled = own.join(F.broadcast(drawn), F.col("own_id") == drawn["doc_id"], "left_semi").distinct().limit(max_unlabelled)
    texts = positive.select(F.lit(True).alias("positive"), "text").unionByName(unlabelled.select(F.lit(False).alias("positive"), "text"))
    sample = scratch.save(_word_sets(texts).withColumn("row", F.monotonically_increasing_id()), "sample")
    size = sample.agg(F.count("*").alias("n"), F.count_if("positive").alias("positive")).first()
    if not size["positive"] or size["positive"] == size["n"]:
        return none
    words = scratch.save(telling_words(sample, size["n"], size["positive"], max_words), "words")
    holds = sample.select("row", F.explode("words").alias("word")).join(words, "word").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"))
    got = sample.select("row", "positive").join(holds, "row", "left").orderBy("row").select("positive", F.coalesce("at", F.array().cast("array<int>")).alias("at")).toArrow()
    lists = got.column("at").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    names = words.orderBy("at").toArrow().column("word").to_numpy().view(np.uint64)
    n_all, n_others = free.count(), others.count()
    hidden = max(0.0, share * n_all - (n_all - n_others)) / n_others
    x = Sample(rows, lists.values.to_numpy(), len(names), got.column("positive").to_numpy(), share, hidden, n_others / n_all)
    return Classifier(names, *fit_nnpu(x))


def score_documents(spark: SparkSession, docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` double, the score of the whole text (null: empty), however long; no other column is an input.

    A column of that name is replaced; repeated rows each get their score; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(model)
    rest = [f for f in docs.schema.fields if f.name != column]
    names = [f.name for f in rest]
    at = names.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{column}` double"])

    def make():
        score = shared.value.scorer()

        def on_batch(batch: pa.RecordBatch):
            for i in range(0, batch.num_rows, SLICE):
                piece = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([score(x) for x in column_bytes(piece.column(at))], pa.float64())], [*names, column])

        return on_batch

    return map_batches(docs.select(*names), make, schema)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(spark, docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
