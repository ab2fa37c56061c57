"""The corpus pipeline, stage by stage, on the smallest tables."""

from collections import Counter

import corpus_pipeline
import pytest
from auricle.llm import mixing, pii, simhash, toxicity, unigram
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    out, at = [docs], tmp_path_factory.mktemp("pipeline")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], data_dir).write.parquet(str(at / name))
        out.append(spark.read.parquet(str(at / name)))
    return out


def test_toxic_go(spark, data_dir, stages):
    model = toxicity.train(spark, stages[0], spark.read.parquet(f"{data_dir}/labels.parquet"))
    score = model.scorer()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect() if score((r.text or "").encode()) < 0.7}


def test_one_document_of_each_group(stages):
    before, after = stages[1].collect(), stages[2].collect()
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in before}
    for r in before:
        near = [k.doc_id for k in after if (prints[k.doc_id] ^ prints[r.doc_id]).bit_count() <= 2]
        assert near and (r.doc_id not in near or len(near) == 1)


def test_redaction_and_mix(stages):
    before, after = {r.doc_id: r for r in stages[2].collect()}, stages[3].collect()
    assert len(before) == len(after)
    for r in after:
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        if not pii.base_spans(before[r.doc_id].text):
            assert "[FOUND]" in r.text or r.text == before[r.doc_id].text
    mixed = Counter(r.doc_id for r in stages[4].collect())
    assert set(mixed) == set(before) and max(mixed.values()) <= mixing.MAX_EPOCHS


def test_encoding(stages):
    vocab = unigram.vocabulary(unigram.read_model())
    text = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert unigram.decode(vocab, r.ids) == text[r.doc_id] and r.n_ids == len(r.ids)
    assert stages[1].columns == stages[4].columns == stages[0].columns


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those the operators work with."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "call +1 (555) 010-2030 now", "en", "a", 26), (1, "call +1 (555) 010-2030 now", "en", "a", 26), (2, "call +1 (555) 010-2030 now", None, "b", 26), (3, "", "en", "a", 0), (4, None, None, None, None),
        (None, None, None, None, None), (None, "a text without id", "en", "b", None), (5, long, "de", "c", len(long)), (6, "short", "en", "", 5), (7, "token = 0123456789abcdef0123456789abcdef", "en", "a", 40),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "hash", "spans", "nth", "key", "size", "weight", "copies", "u", "fp", "row", "words", "salt", "n_ids"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def test_stages_on_odd_tables(spark, data_dir, tmp_path):
    docs = odd_documents(spark)
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, data_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == before.columns
        counts.append(docs.count())
    # null and empty texts are one group, as are the copies; every document is taken once or twice
    assert counts[0] == 10 and counts[1] == counts[2] == 6 and 6 <= counts[3] <= 12 and counts[4] == counts[3]
    assert docs.schema["n_ids"].dataType.simpleString() == "bigint" and docs.where("fp = 'clash'").count() == counts[4]
    redacted = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "personal_data")).collect()}
    assert redacted[1] == "call [PHONE] now" and redacted[6] == "short"


def test_stages_on_an_empty_table(spark, data_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_documents(spark).limit(0), data_dir).count() == 0


def test_run(spark, data_dir):
    assert corpus_pipeline.run(spark, data_dir).count() > 0


def test_workers_hold_few_texts(spark, monkeypatch):
    """Stages send at most BATCH_ROWS texts to a worker at a time, a smaller setting stays, and spans are searched SLICE texts at a time."""
    import corpus_pipeline
    import pyarrow as pa

    from auricle.llm import common

    key, sizes = corpus_pipeline.BATCH_SETTING, []
    before = spark.conf.get(key)
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for setting, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("300", 300)):
            spark.conf.set(key, setting)
            got = corpus_pipeline.in_small_batches(lambda s, docs, d: docs.mapInArrow(count, "n long"))(spark, spark.range(0, 2500, 1, 1), "")
            found = [r.n for r in got.collect()]
            assert max(found) == most and sum(found) == 2500
    finally:
        spark.conf.set(key, before)
    one = lambda batch: (sizes.append(batch.num_rows) or batch for _ in range(1))
    out = list(common.sliced(one)(pa.RecordBatch.from_pydict({"x": list(range(1200))})))
    assert sizes == [500, 500, 200] and [x for b in out for x in b.column(0).to_pylist()] == list(range(1200))
