"""Benchmark decontamination by training suffix arrays (operator 10).

Each shard of documents (a bounded slice of a partition) gets a suffix array over its words:
the sorted list of positions by the words that follow, as many as a window has. Every test suffix
(the window at each place of each item) is binary-searched in every shard, which gives all places
where it stands; suffixes that follow each other in item and document make up the longest
verbatim matches, with their places. A document is affected if its longest match is a window (or
a whole shorter item) at least. A position whose word no item has, or from which too few item
words follow to hold the shortest window, cannot start a match, so the array leaves it out.

The items go to the tasks in blocks of at most ``BLOCK_WORDS`` words: one pass over the
documents for each block. A block is its word numbers and windows, so what is built in the driver
and broadcast grows with the words of a block, not with the length of its items; a longer item is
cut into blocks that overlap by a window less one word, and its matches are put together again.
The rows of the benchmark stream through the driver, a bounded number at a time. What a pass
gives is the same for one block and for many: the hit spans, which are merged, and the matches,
which go on where a row's next one begins in the same line.

Rows: a null text has no words; an item without words matches nothing; items that share a
window all count; an item is an id, whatever rows and texts it has; repeated document ids keep
their rows (of one id and text the digests are equal). Null item ids count as hits, but are
no items: they are neither counted nor listed. Equally long matches: the first place, then the
smallest item id. Without items, or without documents, nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, id_text, map_slices
from echogrid.shared import materialize

WINDOW = 10
#: Item words that one pass broadcasts at most.
BLOCK_WORDS = 1_000_000
#: Bytes of texts in one shard, unless a single text is longer.
SLICE = 8 << 20
_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of ASCII letters, digits and all other non-ASCII characters."""
    return text.translate(_WORD).split()


Part = tuple[str | None, int, int, list[bytes]]


def pieces(w: list[bytes], window: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """An item in parts of at most ``most`` words, a window at least, that hold each of its windows once, with their places."""
    step = max(1, most - window + 1)
    for at in range(0, max(1, len(w) - window + 1), step):
        yield at, w[at : at + step + window - 1]


def item_blocks(items: Iterable[tuple[str | None, int, bytes]], most: int, window: int) -> Iterator[list[Part]]:
    """Blocks of ``item, number of its row, place of the part in it, words``."""
    block, held = [], 0
    for name, row, text in items:
        whole = words(text)
        if not whole:
            continue
        for at, w in pieces(whole, window, most):
            if block and held + len(w) > most:
                yield block
                block, held = [], 0
            block.append((name, row, at, w))
            held += len(w)
    if block:
        yield block


class Searched:
    """One block of items, made ready once in the driver: word numbers and windows."""

    def __init__(self, block: list[Part], window: int = WINDOW):
        self.names, self.rows = [p[0] for p in block], [p[1] for p in block]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for p in block for w in p[3]}))}
        self.window, self.shortest = window, min(window, min(len(p[3]) for p in block))
        sizes = np.array([len(p[3]) for p in block])
        counts = np.maximum(1, sizes - window + 1)
        # Of each window: its part of the block, its place in the item's row and its words.
        self.part = np.repeat(np.arange(len(block), dtype=np.int32), counts)
        self.at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - np.array([p[2] for p in block]), counts)
        self.width = np.minimum(window, sizes)[self.part]
        grid, done = np.zeros((len(self.part), window), ">u4"), 0
        for p, n in zip(block, counts.tolist(), strict=True):
            ids = np.array([self.vocab[w] for w in p[3]] + [0] * (window - len(p[3])), ">u4")
            grid[done : done + n] = np.lib.stride_tricks.sliding_window_view(ids, window)
            done += n
        self.keys = np.frombuffer(grid.tobytes(), f"S{4 * window}")

    def ends(self) -> np.ndarray:
        """What stands behind all words that begin with each window."""
        raw = np.zeros((len(self.keys), 4 * self.window + 4), np.uint8)
        raw[:, :-4] = np.frombuffer(self.keys.tobytes(), np.uint8).reshape(len(raw), -1)
        raw[np.arange(len(raw))[:, None], 4 * self.width[:, None] + np.arange(4)] = 255
        return np.frombuffer(raw.tobytes(), f"S{4 * self.window + 4}")


def numbered(docs: list[list[bytes]], vocab: dict[bytes, int]) -> np.ndarray:
    """Word numbers of all documents, 0 for a word of no item and after each document."""
    get = vocab.get
    return np.fromiter((get(w, 0) for x in docs for w in (*x, b"")), np.uint32, sum(map(len, docs)) + len(docs))


def suffix_array(ids: np.ndarray, shortest: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the item words that follow, and those words as sortable bytes."""
    stops = np.flatnonzero(ids == 0)
    begins = np.concatenate([[0], stops[:-1] + 1])
    long = stops - begins >= max(1, shortest)
    run, kept = _spread(begins[long], stops[long] - max(1, shortest) + 1)
    follow = np.minimum(stops[long][run] - kept, depth)
    cols = np.arange(depth)
    grid = np.where(cols[None, :] < follow[:, None], ids[np.minimum(kept[:, None] + cols[None, :], len(ids) - 1)], 0).astype(">u4")
    keys = np.frombuffer(grid.tobytes(), f"S{4 * depth}") if len(kept) else np.zeros(0, f"S{4 * depth}")
    order = np.argsort(keys, kind="stable")
    return kept[order], keys[order]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals: the number of the interval and each place in it."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Shard:
    """The matches of one shard's documents with a block: words of each, and maximal runs of matching suffixes."""

    def __init__(self, texts: list[bytes], s: Searched):
        docs = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in docs], np.int64)
        ends = np.cumsum(self.sizes + 1)
        ids = numbered(docs, s.vocab)
        place, keys = suffix_array(ids, s.shortest, s.window) if len(ids) else (ids.astype(np.int64), ids)
        which, at = _spread(np.searchsorted(keys, s.keys, "left"), np.searchsorted(keys, s.ends(), "left")) if len(place) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pos = place[at]
        # Suffixes of one part that match one word apart in item and document are one match.
        part, lag = s.part[which], pos - s.at[which]
        order = np.lexsort((pos, lag, part))
        part, lag, pos, which = part[order], lag[order], pos[order], which[order]
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (lag[1:] != lag[:-1]) | (pos[1:] != pos[:-1] + 1)][: len(pos)])
        length = np.diff(np.r_[first, len(pos)]) + s.width[which[first]] - 1
        doc = np.searchsorted(ends, pos[first], "right")
        begin = pos[first] - (ends[doc] - self.sizes[doc] - 1)
        back = np.argsort(doc, kind="stable")
        self.doc, self.part, self.word, self.length = doc[back], part[first][back], begin[back], length[back]
        self.at = s.at[which[first]][back]
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))


_MATCH = pa.struct([("row", pa.int64()), ("lag", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("item", pa.string())])
_FOUND = "doc_id long, key long, n_words long, m array<struct<row: long, lag: long, word: long, n: long, item: string>>"


def _blocks(bench: DataFrame, window: int) -> Iterator[Searched]:
    """The items arrive block by block; the driver never holds more than some partitions of them."""
    rows = bench.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary")).orderBy("item_id").toLocalIterator(prefetchPartitions=False)
    yield from (Searched(b, window) for b in item_blocks(((name, k, bytes(text)) for k, (name, text) in enumerate(rows)), BLOCK_WORDS, window))


def _found(base: DataFrame, shared, every: bool) -> DataFrame:
    """The matches of each document with one block; documents without any only if ``every``."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
        s = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts = byte_texts(batch)
            if s is None:
                x = None
                sizes, bounds = np.array([len(words(t)) for t in texts], np.int64), np.zeros(len(texts) + 1, np.int64)
                flat = pa.array([], _MATCH)
            else:
                x = Shard(texts, s)
                sizes, bounds = x.sizes, x.bounds
                names = pa.array([s.names[k] for k in x.part.tolist()], pa.string())
                rows = np.array(s.rows, np.int64)[x.part]
                flat = pa.StructArray.from_arrays([pa.array(rows), pa.array(x.word - x.at), pa.array(x.word), pa.array(x.length.astype(np.int64)), names], fields=list(_MATCH))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)], list("abcd"))
            return out if every else out.filter(pa.array(np.diff(bounds) > 0))

        return each

    return map_slices(base, make, _FOUND, SLICE)


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items array<string>, n_items, longest, longest_word, longest_item`` of each document (``doc_id, text``).

    ``longest``: words of the longest verbatim match with an item, of a window at least (null:
    none); ``longest_word`` where it begins in the document; ``longest_item`` with which item.
    """
    spark, base, more = docs.sparkSession, id_text(docs).withColumn("key", F.xxhash64("doc_id", "text")), None
    blocks = _blocks(bench, window)
    shared = spark.sparkContext.broadcast(next(blocks, None))
    found = _found(base, shared, True)
    second = next(blocks, None)
    if second is None:
        return finished(found)
    # More blocks: only documents with matches are written, and matches of one document meet again.
    found = materialize(found, "decontam")
    for s in chain([second], blocks):
        shared.unpersist()
        shared = spark.sparkContext.broadcast(s)
        one = materialize(_found(base, shared, False), "decontam").select("doc_id", "key", "m")
        more = one if more is None else more.unionByName(one)
    every = more.unionByName(found.where(F.size("m") > 0).select("doc_id", "key", "m")).groupBy(F.col("doc_id").alias("i"), F.col("key").alias("k")).agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"))
    none = F.array().cast(every.schema["m"].dataType)
    joined = found.drop("m").join(every, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").withColumn("m", F.coalesce("m", none))
    return finished(joined)


def finished(found: DataFrame) -> DataFrame:
    """Merged spans, distinct items and the longest match of each document's matches."""
    ends = lambda x: x["word"] + x["n"]
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    spans = F.array_sort(F.transform("m", lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))))
    covered = F.aggregate(spans, start, lambda a, x: F.struct(F.greatest(a["end"], ends(x)).alias("end"), (a["n"] + F.greatest(F.lit(0), ends(x) - F.greatest(a["end"], x["word"]))).alias("n")))["n"]
    # Of one row and lag, a match that begins before the one before it ends (or there) goes on with it.
    none = F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("lag", "long"), ("word", "long"), ("end", "long"), ("best", "struct<n: long, word: long, item: string>"))))

    def go_on(a: Column, x: Column) -> Column:
        same = (a["row"] == x["row"]) & (a["lag"] == x["lag"]) & (x["word"] <= a["end"])
        word = F.when(same, a["word"]).otherwise(x["word"])
        end = F.when(same, F.greatest(a["end"], ends(x))).otherwise(ends(x))
        now = F.struct((end - word).alias("n"), word.alias("word"), x["item"].alias("item"))
        best = a["best"]
        after = (now["word"] > best["word"]) | ((now["word"] == best["word"]) & (now["item"].isNull() | (now["item"] >= best["item"])))
        kept = best.isNotNull() & ((best["n"] > now["n"]) | ((best["n"] == now["n"]) & after))
        return F.struct(x["row"].alias("row"), x["lag"].alias("lag"), word.alias("word"), end.alias("end"), F.when(kept, best).otherwise(now).alias("best"))

    longest = F.aggregate(F.array_sort("m"), none, go_on)["best"]
    items = F.array_sort(F.array_distinct(F.filter(F.transform("m", lambda x: x["item"]), lambda i: i.isNotNull())))
    out = found.select("doc_id", "n_words", covered.alias("n_hit"), items.alias("items"), longest.alias("best"))
    return out.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), F.col("best.n").alias("longest"), F.col("best.word").alias("longest_word"), F.col("best.item").alias("longest_item"))


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, doc_id, word, n_words``: each item's longest verbatim matches over all shards, with places."""
    spark, base, out = docs.sparkSession, id_text(docs).withColumn("key", F.xxhash64("doc_id", "text")), None
    for s in _blocks(bench, window):
        shared = spark.sparkContext.broadcast(s)
        one = materialize(_found(base, shared, False).select("doc_id", "key", F.inline("m")), "matches")
        shared.unpersist()
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "item_id string, doc_id long, word long, n_words long")
    line = Window.partitionBy("doc_id", "key", "row", "lag").orderBy("word")
    begins = F.coalesce((F.col("word") > F.max(F.col("word") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    runs = out.distinct().withColumn("begins", begins).withColumn("run", F.sum("begins").over(line))
    whole = runs.groupBy("doc_id", "key", "row", "lag", "run").agg(F.first("item").alias("item_id"), F.min("word").alias("word"), (F.max(F.col("word") + F.col("n")) - F.min("word")).alias("n_words"))
    found = materialize(whole.select("item_id", "doc_id", "word", "n_words").distinct(), "matches")
    most = found.groupBy("item_id").agg(F.max("n_words").alias("most"))
    own = most.select(F.col("item_id").alias("i"), "most")
    return found.join(own, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("n_words") == F.col("most")), "left_semi")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that match any item for a window or more; all columns stay.

    The rows are filtered where they are, without a join: one filter for each block of items. What
    a block leaves is written before the next one, so one block at a time is in memory. Null ids
    and repeated rows are filtered by their own texts; a row with a null text stays.
    """
    shared = None
    for s in _blocks(bench, window):
        if shared is not None:
            docs = materialize(docs, "clean")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(s)
        docs = docs.where(_clean(shared)(F.col("text").cast("string")))
    return docs


def _bounded(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in lists of at most so many bytes; a longer text is a list of its own."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > most:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [(x or "").encode() for x in part]
            out = [np.diff(Shard(some, shared.value).bounds) == 0 for some in _bounded(texts, SLICE)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return clean


def digest(found: DataFrame) -> DataFrame:
    """The result columns of ``hits``: items as a hash, and whether any word is hit."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_word", "longest_item")


#: The same by plain comparison of windows, for the oracle.
SQL = """
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents, low),
b AS (SELECT row_number() OVER () AS q, CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark, low),
bw AS (SELECT q, item_id, j, least(len(w), 10) AS n, array_to_string(w[j:j + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
m AS (SELECT r, i, n, item_id, q, i - j AS lag FROM dw JOIN bw USING (n, k)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM m GROUP BY r),
runs AS (SELECT r, item_id, min(i) - 1 AS word, max(i) + n - min(i) AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q, lag ORDER BY i) AS g FROM m) GROUP BY r, q, lag, g, n, item_id),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY size DESC, word, item_id NULLS LAST) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(size AS BIGINT) AS longest, CAST(word AS BIGINT) AS longest_word, top.item_id AS longest_item
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN top USING (r)
"""
