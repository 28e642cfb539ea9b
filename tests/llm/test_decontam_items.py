"""Benchmark items with repeated rows, several texts and long texts, against the SQL of operator 10."""

import pickle

import duckdb
import numpy as np
import pytest

from echogrid.llm import suffix_decontam

LONG = " ".join(f"item{k}" for k in range(300))
BENCH = [
    (None, "an item without an id"),
    (1, "jumps over the lazy dog and away it goes"),
    (1, "jumps over the lazy dog and away it goes"),
    (2, "brown fox jumps over the lazy dog and away it goes"),
    (2, "a second text of the same item"),
    (3, LONG),
    (4, "nothing like it"),
]
DOCS = [
    (1, "The Quick brown fox, jumps over the lazy dog and away it goes."),
    (2, "no hit, but a second text of the same item; then jumps over the lazy dog and away it goes"),
    (3, "x " + " ".join(LONG.split()[7:270]) + " y"),
    (4, " ".join(LONG.split()[:9])),
    (5, None),
    (6, "an item without an id"),
    (6, "an item without an id"),
    (6, ""),
    (None, "x " + " ".join(LONG.split()[7:270]) + " y"),
]


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_items_are_distinct_ids(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_decontam, "BLOCK_WORDS", most)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    db = duckdb.connect()
    for name, rows in (("documents(doc_id BIGINT", DOCS), ("benchmark(item_id BIGINT", BENCH)):
        db.execute(f"CREATE TABLE {name}, text VARCHAR)")
        db.executemany(f"INSERT INTO {name.split('(')[0]} VALUES (?, ?)", rows)
    found = suffix_decontam.digest(suffix_decontam.hits(docs, bench))
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_word", "longest_item"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(db.execute(suffix_decontam.SQL).fetchall(), key=repr)
    assert sorted(r.doc_id for r in suffix_decontam.decontaminate(docs, bench).collect()) == [4, 5, 6]


def test_a_block_grows_with_its_words_not_with_its_longest_item():
    rng = np.random.default_rng(1)
    item = " ".join(f"w{k}" for k in rng.integers(0, 1000, 3000)).encode()
    (block,) = suffix_decontam.item_blocks([("1", 0, item), ("2", 1, b"short one")], 2_000_000, 10)
    assert len(pickle.dumps(suffix_decontam.Searched(block))) < 1_000_000


def test_long_items_are_cut_into_blocks():
    item = [b"%d" % k for k in range(1000)]
    blocks = list(suffix_decontam.item_blocks([("1", 0, b" ".join(item))], 64, 10))
    assert len(blocks) > 1 and max(sum(len(p[3]) for p in b) for b in blocks) <= 64
    assert all(p[3][0] == b"%d" % p[2] for b in blocks for p in b)
    windows = [tuple(w[k : k + 10]) for b in blocks for *_, w in b for k in range(len(w) - 9)]
    assert windows == [tuple(item[k : k + 10]) for k in range(991)]


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_longest_match_of_a_long_item(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_decontam, "BLOCK_WORDS", most)
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    found = sorted((tuple(r) for r in suffix_decontam.matches(docs, bench).select("item_id", "doc_id", "word", "n_words").collect()), key=repr)
    assert found == [("1", 1, 4, 9), ("1", 2, 11, 9), ("2", 1, 2, 11), ("3", 3, 1, 263), ("3", None, 1, 263), (None, 6, 0, 5)]


def test_an_item_of_many_words_is_searched_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    item = [b"w%d" % k for k in rng.integers(0, 5000, 100_000)]
    tracemalloc.start()
    (block,) = suffix_decontam.item_blocks([("1", 0, b" ".join(item))], 2_000_000, 10)
    shard = suffix_decontam.Shard([b"x " + b" ".join(item[500:90_000])], suffix_decontam.Searched(block))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert (shard.word.tolist(), shard.length.tolist(), shard.at.tolist()) == ([1], [89_500], [500])


def test_no_items_and_no_documents(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string").selectExpr("*", "1 AS m", "2 AS n_words", "3 AS word")
    assert [tuple(r)[2:5] for r in suffix_decontam.hits(docs, bench.limit(0)).select("doc_id", "n_words", "n_hit", "n_items", "longest").collect()] == [(0, 0, None)] * len(DOCS)
    assert suffix_decontam.hits(docs.limit(0), bench).count() == 0 and suffix_decontam.matches(docs, bench.limit(0)).count() == 0
    assert suffix_decontam.decontaminate(docs.selectExpr("*", "1 AS m", "2 AS key"), bench).columns == ["doc_id", "text", "m", "key"]


def test_filter_slices_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffix_decontam, "SLICE", 40)
    texts = [b"a" * 30, b"b" * 30, b"c" * 100, b"", b"d" * 10, b"e" * 30]
    cut = list(suffix_decontam._bounded(texts, 40))
    assert sum(cut, []) == texts and [len(x) for x in cut] == [1, 1, 1, 3]
    docs = spark.createDataFrame([(k, x) for k in range(40) for _, x in DOCS], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert suffix_decontam.decontaminate(docs, bench).count() == 40 * sum(r.n_hit == 0 for r in suffix_decontam.hits(spark.createDataFrame(DOCS, "doc_id long, text string"), bench).collect())

