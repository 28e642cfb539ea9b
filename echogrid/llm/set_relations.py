"""Documents whose shingle sets have a Jaccard similarity of 0.9 or more, by relations between sets (operator 11).

The join is exact. Linked sets of n and m shingles share at least 0.9 of either, so, in any
order that holds for all shingles, the first ``n - ceil(0.9 n) + k`` of the one and those of
the other have k in common. With the order of hashes and k of a tenth, most sets are seen to
be linked with none and go. The others are put in the order of how many sets hold a shingle,
and k = 1: sets that share one of these first shingles are candidates, where the places of the
shared one in both leave room for enough in common; a shingle with more than ``BUCKET`` sets
makes candidates of all of them without naming their pairs. Which sets share a shingle is seen in
the order of all (shingle, set) pairs over the cluster, so a frequent one is spread over many tasks.

Sets that candidates connect are searched together; beyond one block they are parted by size class
and searched in pairs of blocks of bounded size. Each search gives a spanning forest, at most one link a set:

* Index lists are sorted by size and cut into blocks of ``SKIP`` entries whose headers hold the
  sizes and the least position; a block without room for enough in common is skipped whole.
* A set x that was reached from a set y, so is highly similar to it, takes its answers from
  y's. With d of x's shingles not in y and e of y's not in x, what x shares with z lies between
  y's number less e and y's number and d more. Mostly that decides; else y's number is mended
  by the lists of the differing shingles alone.

Equal sets are one node (a hash of 64 bits of the set), so copies are never paired.

Rows: a null or empty text, or one without words, has no shingles and is linked with nothing:
its ``component_id`` is its own id. Fewer words than a shingle's are one shingle. Repeated ids
and rows each keep a row. Null ids keep their row and group, and never give a group its id
unless all its ids are null. Long texts are read whole. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, map_slices
from echogrid.operators.components import graph_components
from echogrid.shared import materialize

WORDS, SEED = 3, 11
#: Sets of one shingle that a plain self-join may pair; more go to the search.
BUCKET = 24
#: Sets, and shingles, in one block of the search; entries in a block of an index list.
SETS, SHINGLES, SKIP = 4096, 1 << 20, 64
#: Rows of a table of hashes that may be broadcast; the frequency of a shingle whose sets are not counted to the end.
LISTED, EDGE = 2_000_000, 2**31 - 1


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles in their order."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    n, digest = max(1, len(found) - WORDS + 1), xxhash.xxh3_64_digest
    hashed = b"".join([digest(b" ".join(found[k : k + WORDS]), SEED) for k in range(n)])
    return np.unique(np.frombuffer(hashed, ">i8").astype(np.int64))


def linked(n, m, common):
    """Whether ``common`` of n and m shingles make a similarity of 0.9 or more."""
    return common * 19 >= (n + m) * 9


def least_common(n):
    """ceil(0.9 n): what a set of n shingles shares with each set that it is linked with, at least."""
    return (9 * n + 9) // 10


def text_hash(docs: DataFrame) -> DataFrame:
    """``doc_id, t, text``, where t is a hash of the text; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc_id, t, node, n, heads`` of each row: the set's hash and size, and its first shingles by hash."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, size, heads = [], [], []
            for s in map(shingles, byte_texts(batch)):
                n = len(s)
                node.append(xxhash.xxh3_64_digest(s.tobytes(), SEED))
                size.append(n)
                heads.append(s[: n - least_common(n) + (n + 9) // 10])
            nodes = np.frombuffer(b"".join(node), ">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(nodes), pa.array(size, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], list("abcde"))

        return each

    return map_slices(text_hash(docs), make, "doc_id long, t long, node long, n long, heads array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, n, s``: the shingles of each text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t) for t in byte_texts(batch)]
            node = np.frombuffer(b"".join([xxhash.xxh3_64_digest(s.tobytes(), SEED) for s in sets]), ">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], list("abc"))

        return each

    return map_slices(texts, make, "node long, n long, s array<long>")


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges, and for each the number of its range."""
    size = stop - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), which


class Search:
    """The sets of one pair of blocks: their shingles by rising frequency, and the index lists."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = n = np.array([len(s) for s in sets], np.int64)  # rising
        self.start = np.concatenate([[0], np.cumsum(n)])
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        owner, token = np.repeat(np.arange(len(n)), n), rank[token]
        order = np.lexsort((token, owner))
        self.token, place = token[order], np.arange(len(order)) - self.start[owner]
        self.full_at, self.full = self._lists(self.token, owner, len(times))
        first = place < n[owner] - least_common(n[owner]) + 1
        self.at, at = self._lists(self.token[first], np.flatnonzero(first), len(times))
        self.owner, self.place = owner[at], place[at]
        blocks = -(-np.diff(self.at) // SKIP)
        self.blocks_at = np.concatenate([[0], np.cumsum(blocks)])
        inside = np.arange(blocks.sum()) - np.repeat(self.blocks_at[:-1], blocks)
        self.begin = np.repeat(self.at[:-1], blocks) + inside * SKIP
        self.end = np.minimum(self.begin + SKIP, np.repeat(self.at[1:], blocks))
        self.least, self.most = n[self.owner[self.begin]], n[self.owner[self.end - 1]]
        self.soonest = np.minimum.reduceat(self.place, self.begin)
        self.mark = np.zeros(len(times), bool)

    @staticmethod
    def _lists(token: np.ndarray, value: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(token, kind="stable")
        return np.searchsorted(token[order], np.arange(tokens + 1)), value[order]

    def shingles(self, x: int) -> np.ndarray:
        return self.token[self.start[x] : self.start[x + 1]]

    def candidates(self, x: int, left: np.ndarray) -> np.ndarray:
        """Sets not reached yet that share a first shingle with x where there is room for enough in common."""
        n = self.n[x]
        own = self.shingles(x)[: n - least_common(n) + 1]
        block, place = _spread(self.blocks_at[own], self.blocks_at[own + 1])
        room = np.minimum(n - place, self.most[block] - self.soonest[block])
        block_ok = (10 * self.most[block] >= 9 * n) & (9 * self.least[block] <= 10 * n) & linked(n, self.least[block], room)
        block, place = block[block_ok], place[block_ok]
        entry, which = _spread(self.begin[block], self.end[block])
        z = self.owner[entry]
        room = np.minimum(n - place[which], self.n[z] - self.place[entry])
        return np.unique(z[left[z] & linked(n, self.n[z], room)])

    def count(self, x: int, z: np.ndarray) -> np.ndarray:
        """What x shares with each of z, directly."""
        self.mark[self.shingles(x)] = True
        at, which = _spread(self.start[z], self.start[z + 1])
        common = np.bincount(which[self.mark[self.token[at]]], minlength=len(z))
        self.mark[self.shingles(x)] = False
        return common

    def change(self, some: np.ndarray, z: np.ndarray) -> np.ndarray:
        """How many of these shingles each of z holds, by their lists."""
        return np.bincount(self.full[_spread(self.full_at[some], self.full_at[some + 1])[0]], minlength=len(self.n))[z]

    def answers(self, x: int, z: np.ndarray, known: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of what x shares with each of z, close enough to decide; ``known`` are those of a similar set."""
        low, high = np.zeros(len(z), np.int64), np.minimum(self.n[x], self.n[z])
        open_ = np.ones(len(z), bool)
        if known is not None and len(known[1]):
            y, zs, lows, highs = known
            at = np.minimum(np.searchsorted(zs, z), len(zs) - 1)
            there = zs[at] == z
            lost, gained = np.setdiff1d(self.shingles(y), self.shingles(x), True), np.setdiff1d(self.shingles(x), self.shingles(y), True)
            low[there] = np.maximum(lows[at[there]] - len(lost), 0)
            high[there] = np.minimum(high[there], highs[at[there]] + len(gained))
            open_ = linked(self.n[x], self.n[z], high) & ~linked(self.n[x], self.n[z], low)
            exact = np.flatnonzero(open_ & there & (lows[at] == highs[at]))
            if len(exact):
                low[exact] = high[exact] = lows[at[exact]] - self.change(lost, z[exact]) + self.change(gained, z[exact])
                open_[exact] = False
        rest = np.flatnonzero(open_)
        if len(rest):
            low[rest] = high[rest] = self.count(x, z[rest])
        return low, high

    def forest(self) -> tuple[list[int], list[int]]:
        """Parents and children of a spanning forest of all links."""
        left, parents, children = np.ones(len(self.n), bool), [], []
        for seed in range(len(self.n)):
            if not left[seed]:
                continue
            left[seed], front = False, [(seed, None)]
            while front and left.any():
                x, known = front.pop()
                z = self.candidates(x, left)
                low, high = self.answers(x, z, known)
                hit = linked(self.n[x], self.n[z], low)
                left[z[hit]] = False
                parents += [x] * int(hit.sum())
                children += z[hit].tolist()
                mine = (x, z[~hit], low[~hit], high[~hit])
                front += [(c, mine) for c in z[hit].tolist()]
        return parents, children


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks, as nodes."""
    group = group.drop_duplicates("node").sort_values(["n", "node"])
    node = group["node"].to_numpy(np.int64)
    parents, children = Search(list(group["s"])).forest()
    return pd.DataFrame({"a": node[np.array(parents, np.int64)], "b": node[np.array(children, np.int64)]})


def in_order(pairs: DataFrame) -> DataFrame:
    """``h, node`` pairs over all partitions in the order of h, then node, so that a shingle of many sets is spread over several."""
    return pairs.repartitionByRange("h", "node").sortWithinPartitions("h", "node")


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted batch: h, node and the first row of each of its runs of one h, and whether a run reaches the batch's edge, so that it may go on elsewhere."""
    h, node = batch.column("h").to_numpy(), batch.column("node").to_numpy()
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    edge = np.zeros(len(start), bool)
    edge[[0, -1]] = True
    return h, node, start, edge


def shared_heads(pairs: DataFrame) -> DataFrame:
    """``node, k``: how many of its first shingles others have among theirs; never too few, so no set is lost: a run at a batch's edge counts as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, node, start, edge = _runs(batch)
                stop = np.r_[start[1:], len(node)]
                some = np.repeat(edge | (node[start] != node[stop - 1]), stop - start)
                nodes, k = np.unique(node[some], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(k)], ["node", "k"])

    return in_order(pairs).mapInArrow(run, "node long, k long").groupBy("node").agg(F.sum("k").alias("k"))


def frequencies(pairs: DataFrame) -> DataFrame:
    """``node, h, k``: how many sets hold each shingle of a set, without those of one set only.

    Runs at a batch's edge have the greatest k there is, in whatever partitions they stand: any order serves that holds for all sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, node, start, edge = _runs(batch)
                size = np.diff(np.r_[start, len(node)])
                k = np.repeat(np.where(edge, EDGE, np.minimum(size, EDGE)), size)
                kept = k > 1
                yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(h[kept]), pa.array(k[kept].astype(np.int32))], list("abc"))

    return in_order(pairs).mapInArrow(run, "node long, h long, k int")


def checked(df: DataFrame) -> DataFrame:
    """A written table of numbers, broadcast only if it has at most ``LISTED`` rows; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= LISTED else df


def linkable(rows: DataFrame) -> DataFrame:
    """``t``: a text of each set that may be linked with another one."""
    hits = shared_heads(rows.where("n > 0").select("node", F.explode("heads").alias("h")))
    sets = rows.where("n > 0").groupBy("node").agg(F.min("t").alias("t"), F.min("n").alias("n"))
    # The other's tenth, of 0.9 n at least, may be the smaller one.
    need = F.floor((9 * F.col("n") + 99) / 100)
    return materialize(sets.join(hits, "node").where(F.col("k") >= need).select("t"), "relations-open")


def size_class(n: Column) -> Column:
    """Sizes of linked sets are in one class or in neighbouring ones (a class is a little wider than 10 to 9)."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.112))).cast("int")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b``: nodes; they join the same sets as all links do."""
    texts = text_hash(docs).select("t", "text").join(checked(linkable(rows)), "t", "left_semi").dropDuplicates(["t"])
    sets = materialize(shingle_sets(texts), "relations-sets")

    # Shingles of one set stand first in the order and pair with none.
    ranked = frequencies(sets.select("node", F.explode("s").alias("h"))).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("s"))
    ranked = ranked.join(sets.select("node", "n"), "node").withColumn("alone", F.col("n") - F.size("s"))
    most = F.col("n") - F.floor((9 * F.col("n") + 9) / 10) + 1 - F.col("alone")
    first = ranked.where(most > 0).select("node", "n", "alone", F.posexplode(F.slice("s", 1, most.cast("int"))).alias("at", "t"))
    first = materialize(first.select("node", "n", (F.col("alone") + F.col("at")).alias("place"), F.col("t.h").alias("h")), "relations-first")
    counts = first.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    hot = materialize(counts.where(F.col("k") > BUCKET).select("h"), "relations-hot")

    x = first.join(counts.where(F.col("k") <= BUCKET).select("h"), "h", "left_semi")
    y = x.select("h", F.col("node").alias("other"), F.col("n").alias("m"), F.col("place").alias("there"))
    room = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("there"))
    pairs = x.join(y, "h").where("node < other AND 10 * least(n, m) >= 9 * greatest(n, m)").where(linked(F.col("n"), F.col("m"), room))

    # Sets that any such shingles connect are searched together, so that each goes once to a block.
    edges = pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(first.join(hot, "h", "left_semi").select(F.col("h").alias("a"), F.col("node").alias("b")))
    root = materialize(graph_components(edges).groupBy("node").agg(F.min("root").alias("root")), "relations-roots")
    named = sets.join(checked(root), "node")
    sums = named.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    blocks = lambda count, total: F.greatest(F.ceil(count / SETS), F.ceil(total / SHINGLES)).cast("int")
    large = materialize(sums.where(blocks(F.col("sets"), F.col("all")) > 1).select("root"), "relations-large")
    one = named.join(checked(large), "root", "left_anti").select("root", F.lit(0).alias("class"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "n", "s")
    # Groups beyond a block: by size class, each with the next one, in pairs of blocks.
    own = size_class(F.col("n"))
    parted = named.join(checked(large), "root", "left_semi").withColumn("class", F.explode(F.array(own, own - 1)))
    cut = parted.groupBy("root", "class").agg(blocks(F.count("*"), F.sum("n")).alias("blocks"))
    dealt = (
        parted.join(cut, ["root", "class"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "s")
    )
    return one.unionByName(dealt).groupBy("root", "class", "i", "j").applyInPandas(forest, "a long, b long")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``."""
    rows = materialize(rows_of(docs), "relations-rows")
    own = rows.select("doc_id", "node", "n")
    roots = graph_components(links(docs, rows))
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = nodes.join(roots.select(F.col("node").alias("at"), "root"), F.col("node") == F.col("at"), "left")
    named = nodes.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows"))
    # Rows alone in their group are their own; only the others look up its id.
    shared = named.join(least.where("rows > 1"), "root").select("node", "component_id", F.lit(True).alias("grouped"))
    found = own.join(shared, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grouped") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return found


#: The same by counting what every two documents share, for the oracle; for tables of some thousand rows.
SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(CAST(text AS VARCHAR), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS h FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k),
l AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS o FROM n UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.o),
g AS (SELECT r.k, min(d.doc_id) AS least FROM r JOIN d ON d.k = r.o GROUP BY r.k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN least ELSE doc_id END AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN g USING (k)
"""
