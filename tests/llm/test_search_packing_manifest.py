"""Lexical search, packing and the Merkle manifest against brute force, SQL, the tokenizer's library and edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import comparable
from pyspark.sql import functions as F

from auricle.llm import lexical, merkle, packing, sql

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
ITEMS = "item_id long, text string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, many languages, marks of other scripts."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(["Alpha", "beta", "gamma-9", "naïve", "Ünder", "x_y", "日本 語", "delta."]) for _ in range(n))
    rows = [(i, f"s{i % 3}", ["en", "de", "é", None, ""][i % 5], i * 10, text(i % 40)) for i in range(60)]
    rows += [(7, "s", "en", 1, "beta beta"), (7, "s", "en", 1, "beta beta"), (7, None, "en", None, "beta")]
    rows += [(None, "s", None, None, None), (None, "s", None, None, None), (None, None, "en", 9_223_372_036_854_775_807, "gamma"), (90, "", "", -5, "")]
    rows += [(91, "long", "zz", 1, text(60_000)), (92, "line", "zz", 0, "a\tb\nc\x0bALPHA\x00beta\x1cbeta")]
    return spark.createDataFrame([(*x,) for x in rows], DOCS).withColumn("pos", F.lit(1)).withColumn("tie", F.lit("x")).withColumn("score", F.lit(0.5))


def items(spark):
    rows = [(1, "Alpha beta"), (2, None), (3, ""), (4, "beta beta beta NAÏVE"), (4, "gamma 9 日本"), (None, "delta"), (5, "nowhere"), (6, "alpha ünder x y語 beta")]
    return spark.createDataFrame(rows, ITEMS).withColumn("rank", F.lit("r"))


def in_duckdb(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_arrow", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_arrow")
    return comparable(con.execute(query).to_arrow_table())


# Lexical search


@pytest.mark.parametrize("block_bytes", [1 << 22, 12])
def test_search_edges(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    docs, asked = odd_documents(spark), items(spark)
    got = lexical.search(spark, docs, asked)
    assert comparable(got.toArrow()) == in_duckdb(sql.LEXICAL, documents=docs, benchmark=asked)


def test_search_small_tiles(spark, monkeypatch):
    """Tiles smaller than the data give the same scores."""
    r = np.random.default_rng(1)
    n_docs, n_terms, n_items = 70, 50, 9
    held = r.random((n_docs, n_terms)) < 0.3
    counts = np.where(held, r.integers(1, 5, (n_docs, n_terms)), 0)
    factors = r.integers(76, 400, n_docs)
    weights = np.where(r.random((n_items, n_terms)) < 0.4, r.integers(1, 9000, (n_items, n_terms)), 0)
    doc, term = np.nonzero(held)
    order = np.argsort(term, kind="stable")
    doc, term = doc[order], term[order]
    impact = lexical.impacts(counts[doc, term], factors[doc])
    starts = np.cumsum([0, *(weights > 0).sum(axis=1)])
    ids, own = np.nonzero(weights > 0)[1], weights[weights > 0]
    want = [[sum(int(weights[i, t]) * (1_000_000_000 * int(counts[d, t]) // (1000 * int(counts[d, t]) + 12 * int(factors[d]))) for t in range(n_terms)) for d in range(n_docs)] for i in range(n_items)]
    for size in (1, 7, 1024):
        monkeypatch.setattr(lexical, "TERM_TILE", size)
        for tile in (range(0, n_items), range(2, 5)):
            assert lexical.score_tile(starts, ids, own, tile, doc, term, impact, n_docs).tolist() == want[tile.start : tile.stop]


def test_products_stay_exact():
    """Sums that doubles can't hold are parted, down to single columns."""
    left = np.array([[2**40 + 1, 3, 2**53 + 1], [1, 2**42 + 7, 5]], np.int64)
    right = np.array([[999_999, 1], [999_983, 7], [3, 1000]], np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(row, column, strict=True)) for column in right.T] for row in left]
    assert lexical.products(left, right).tolist() == want


def test_best_keeps_ties():
    r = np.random.default_rng(2)
    best, every = lexical.Best(3, 5), []
    for _ in range(20):
        scores, docs = r.integers(0, 4, (3, 11)), r.permutation(1000)[:11]
        null = (docs % 13 == 0).astype(np.int64)
        best.add(scores, docs, null)
        every += [(i, -int(scores[i, j]), int(null[j]), int(docs[j])) for i in range(3) for j in range(11) if scores[i, j] > 0]
    want = [x for i in range(3) for x in sorted(e for e in every if e[0] == i)[:5]]
    item, score, null, doc = (x.tolist() for x in best.kept)
    assert list(zip(item, [-s for s in score], null, doc, strict=True)) == want


def test_search_without_rows(spark):
    docs, asked = odd_documents(spark), items(spark)
    assert lexical.search(spark, docs.limit(0), asked).count() == 0
    none = lexical.search(spark, docs, asked.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(spark, docs.where("doc_id = 90"), asked).count() == 0


def test_search_k(spark):
    got = lexical.search(spark, odd_documents(spark), items(spark), k=3)
    assert got.groupBy("item_id", "rank").count().agg(F.max("rank")).first()[0] == 3


# Packing


def library_ids(text):
    from tokenizers import Tokenizer

    global _library
    if "_library" not in globals():
        import public_tokenizers

        _library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*_library.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(docs, pieces, window=1024):
    """Every id of every document in one piece, sequences without gaps, full or of a power of two."""
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple(library_ids(text))] += 1
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        parts[p["doc_id"], p["doc_tokens"]].append((p["start"], tuple(np.frombuffer(p["ids"], "<u4").tolist())))
        assert p["length"] * 4 == len(p["ids"]) > 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    for key, found in parts.items():
        wholes = [ids for (doc_id, ids), n in want.items() if (doc_id, len(ids)) == key for _ in range(n)]
        assert sum(len(ids) for _, ids in found) == sum(map(len, wholes))
        assert all(any(ids == w[start : start + len(ids)] for w in wholes) for start, ids in found)
        covered = Counter(i for start, ids in found for i in range(start, start + len(ids)))
        assert set(covered.values()) <= {len(wholes)}
    assert sum(map(len, parts.values())) == len(pieces) and {k for k in parts} == {(d, len(ids)) for d, ids in want}
    return len(sequences)


@pytest.mark.parametrize("window", [1024, 16])
def test_packing_edges(spark, window):
    docs = odd_documents(spark).repartition(3)
    extra = spark.createDataFrame([(200, "ends here<|endoftext|>  and\n\n goes on 🙂 ￿ Ɐ"), (201, "  "), (202, "a" * 3000), (203, "don't we'll 12a b2 ..x")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    check_packing([tuple(r) for r in both.collect()], [r.asDict() for r in packing.pack_documents(spark, both, window=window).collect()], window)


def test_packing_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    pieces = [r.asDict() for r in packing.pack_documents(spark, docs).collect()]
    check_packing([tuple(r) for r in docs.select("doc_id", "text").collect()], pieces)
    got = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in packing.pack_query(spark, data_dir).collect()}
    assert got == {(p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"]), p["sequence_id"], p["offset"]) for p in pieces}


def test_packing_runs_again(spark, data_dir):
    first = packing.pack_query(spark, data_dir).toArrow()
    assert len(set(first.column("doc_id").to_pylist())) == 200
    assert comparable(first) == comparable(packing.pack_query(spark, data_dir).toArrow())


def test_encoding_in_parts(monkeypatch):
    encode = packing.encoder(packing.read_tokenizer())
    r = random.Random(3)
    text = "".join(r.choice(["word", " ", "  ", "\n", "\t", "7", "don't", "é", ".", "<|endoftext|>", "ﬀ", " a"]) for _ in range(5000))
    monkeypatch.setattr(packing, "PART", 20)
    assert np.frombuffer(encode(text), "<u4").tolist() == library_ids(text)[:-1]
    assert encode(None) == encode("") == b""


def test_best_fit_decreasing():
    for seed in range(30):
        r = random.Random(seed)
        size = r.choice([8, 100, 1024])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 300))]
        want, room = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fitting = [(room[w], w) for w in range(len(room)) if room[w] >= lengths[i]]
            w = min(fitting)[1] if fitting else len(room)
            if not fitting:
                want.append([])
                room.append(size)
            want[w].append(i)
            room[w] -= lengths[i]
        got = packing.best_fit_decreasing(lengths, size)
        # ties among equally tight windows may go either way: what must agree is how full the windows get
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(sum(lengths[i] for i in w) for w in want)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))


def test_packing_of_equal_lengths():
    """Pieces that fit no window together are cut just where windows are levelled, and waiting pieces cross blocks."""
    packer, rows = packing.Packer(1024, 0), []
    ids = np.arange(700, dtype="<u4").tobytes()
    for i in range(500):
        for b in packer.add(i, ids):
            rows += b.to_pylist()
        if i % 100 == 99:
            for b in packer.flush(False):
                rows += b.to_pylist()
            assert packer.held < 1024
    for b in packer.flush(True):
        rows += b.to_pylist()
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
        assert r["ids"] == ids[4 * r["start"] : 4 * (r["start"] + r["length"])] and r["doc_tokens"] == 700
    assert sum(sizes.values()) == 350_000 and sum(n < 1024 for n in sizes.values()) == (350_000 % 1024).bit_count()
    assert len(rows) < 500 + len(sizes)


def test_packing_without_rows(spark):
    assert packing.pack_documents(spark, odd_documents(spark).limit(0)).count() == 0


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Multiset of (doc_id, leaf, subroot, root, proof, folded root), all levels in memory."""

    def written(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row, more=0):
        n = row["n_chars"]
        return h(*[written(row[c]) for c in ("doc_id", "source", "lang")], written(None if n is None else n + more), written(row["text"]))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            out.append(nodes)
        return out

    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in langs])
    found = []
    for g, lang in enumerate(langs):
        for i, row in enumerate(groups[lang]):
            wrong = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node, siblings = leaf(row, int(wrong)), []
            for tree, at in ((trees[lang], i), (top, g)):
                for nodes in tree[:-1]:
                    run = nodes[at - at % 2 : at - at % 2 + 2]
                    siblings += [x for j, x in enumerate(run) if j != at % 2]
                    node = h(*[node if j == at % 2 else x for j, x in enumerate(run)])
                    at //= 2
            found.append((row["doc_id"], leaf(row), trees[lang][-1][0], top[-1][0], h(*siblings), node))
    return Counter(found)


def told(df):
    text = lambda c: F.lower(F.hex(c))
    rows = df.select("doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(text("siblings"), 256), text("folded")).collect()
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_edges(spark, height):
    docs = odd_documents(spark)
    rows = [r.asDict() for r in docs.collect()]
    got = told(merkle.manifest(spark, docs, height))
    assert got == plain_manifest(rows)


def test_manifest_sql(spark):
    docs = odd_documents(spark)
    got = merkle.manifest(spark, docs)
    text = lambda c: F.lower(F.hex(c))
    shown = got.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("siblings"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
    assert comparable(shown.toArrow()) == in_duckdb(sql.MERKLE, documents=docs)


def test_manifest_of_one_row_and_none(spark):
    docs = odd_documents(spark)
    one = docs.where("doc_id = 91")
    assert told(merkle.manifest(spark, one)) == plain_manifest([r.asDict() for r in one.collect()])
    assert merkle.manifest(spark, docs.limit(0)).count() == 0


def test_manifest_of_copies(spark):
    """Rows repeated in full, most of the table, are spread over ranges."""
    docs = spark.range(3000).select(F.expr("if(id < 2500, 1, id)").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.lit("abc").alias("text"))
    assert told(merkle.manifest(spark, docs, 4)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_addresses():
    """A van Emde Boas layout: a complete tree's upper half lies in front, then each tree below it as one stretch."""
    for levels in range(1, 12):
        where = merkle.addresses(levels)
        assert sorted(np.concatenate(where).tolist()) == list(range(2**levels - 1))
        top = levels // 2
        if top:
            assert np.concatenate(where[:top]).max() == 2**top - 2
            size = 2 ** (levels - top) - 1
            for i in range(2**top):
                own = np.concatenate([where[d].reshape(2**top, -1)[i] for d in range(top, levels)])
                assert own.min() == 2**top - 1 + i * size and own.max() - own.min() == size - 1
    assert [x.tolist() for x in merkle.addresses(4)] == [[0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]]


def test_subtree():
    for n in (1, 2, 3, 5, 8):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        tree = merkle.Subtree.build(leaves, 3)
        assert all(merkle.fold(leaves[i], *tree.path(i)) == tree.root() for i in range(n))
        assert merkle.fold(leaves[0][::-1], *tree.path(0)) != tree.root()
