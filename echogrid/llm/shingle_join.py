"""Near-duplicate texts of the pipeline: operator 3's links and every pair of five-word shingle sets that are alike.

Two texts are alike if the Jaccard similarity of their sets of five-word shingles is 0.8 or
more. The join is exact. If two sets of n and m shingles are alike, they share at least 0.8 n
and 0.8 m of them, so, in any order that holds for all shingles, the first
``n - ceil(0.8 n) + k`` of the one and those of the other have k in common.

First the order of the hashes and k = 0.2 n: a text of which too few of these shingles stand in
another text is alike to none and goes. Among the others, the order of how many texts have a
shingle and k = 1: texts that share one of these are compared. A shingle with more than
``BUCKET`` texts goes to a search that emits a spanning forest, in blocks of ``BLOCK`` texts,
as in operator 3; no pair is left out.

Rows: a null text is an empty one. Of each group one row stays: the smallest id, null ids last;
of rows of one id the smallest text hash, of equal rows one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm import simhash
from echogrid.llm.common import byte_texts, map_slices
from echogrid.llm.suffix_decontam import _spread
from echogrid.shared import materialize

WORDS = 5
#: Texts of one shingle that a plain self-join may pair; more go to the search.
BUCKET = 24
#: Texts in one block of the search.
BLOCK = 1024


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles in their order; a text of fewer words is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.int64)
    n, digest = max(1, len(found) - WORDS + 1), xxhash.xxh64_digest
    hashed = b"".join([digest(b" ".join(found[k : k + WORDS]), simhash.SEED) for k in range(n)])
    return np.unique(np.frombuffer(hashed, ">i8").astype(np.int64))


def alike(n: int, m, common):
    """Whether ``common`` of n and m shingles make a similarity of 0.8 or more."""
    return common * 9 >= (n + m) * 4


def least_common(n):
    """ceil(0.8 n): what a set of n shingles shares with each set that it is alike to, at least."""
    return (4 * n + 4) // 5


def rows_of(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fp`` of each row: the hash of the text and operator 3's fingerprint."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join([simhash.fingerprint(x, WORDS) for x in byte_texts(batch)]), ">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(fp)], list("abc"))

        return each

    return map_slices(noded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "node", "text"), make, "doc_id long, node long, fp long")


def noded(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``, the hash of the text; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("node", F.xxhash64("text"))


def heads(texts: DataFrame) -> DataFrame:
    """``node, need, h``: each text's first shingles by hash, and how many of them others must have."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, out, need, size = batch.column("node").to_numpy(), [], [], []
            for s in map(shingles, byte_texts(batch)):
                n = len(s)
                out.append(s[: n - least_common(n) + (n + 4) // 5])
                # The other's k, 0.2 of 0.8 n at least, may be the smaller one.
                need.append((4 * n + 24) // 25)
                size.append(len(out[-1]))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, size)), pa.array(np.repeat(np.array(need, np.int32), size)), pa.array(np.concatenate(out))], list("abc"))

        return each

    return map_slices(texts, make, "node long, need int, h long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, fp, n, s``: the shingles of each text."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = byte_texts(batch)
            sets = [shingles(t) for t in texts]
            fp = np.frombuffer(b"".join([simhash.fingerprint(t, WORDS) for t in texts]), ">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], list("abcd"))

        return each

    return map_slices(texts, make, "node long, fp long, n int, s array<long>")


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the texts of one block (or pair of blocks) that are alike."""
    group = group.drop_duplicates("node")
    fp, n = group["fp"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    token = np.unique(np.concatenate(list(group["s"])), return_inverse=True)[1]
    ends, order = np.cumsum(n), np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(n)), n)[order]
    at = np.searchsorted(token[order], np.arange(token.max() + 2))
    left, parents, children = np.ones(len(n), bool), [], []
    for seed in range(len(n)):
        if not left[seed]:
            continue
        left[seed], front = False, [seed]
        while front and left.any():
            x = front.pop()
            own = token[ends[x] - n[x] : ends[x]]
            common = np.bincount(owner[_spread(at[own], at[own + 1])[1]], minlength=len(n))
            hit = np.flatnonzero(left & alike(n[x], n, common))
            left[hit] = False
            parents.append(np.repeat(fp[x], len(hit)))
            children.append(fp[hit])
            front.extend(hit.tolist())
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, children))
    return pd.DataFrame({"a": a, "b": b})


def links(docs: DataFrame) -> DataFrame:
    """``a > b``: fingerprints of texts that join the same texts as all alike pairs do."""
    texts = noded(docs).select("node", "text")
    same = Window.partitionBy("h")
    shared = heads(texts).select("node", "need", F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi")).where("lo <> hi")
    open_ = materialize(shared.groupBy("node").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("node"), "alike-open")
    sets = materialize(shingle_sets(texts.join(open_, "node", "left_semi").dropDuplicates(["node"])), "alike-sets")

    flat = sets.select("node", "n", F.explode("s").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    # Shingles of one text stand first in the order and pair with none.
    ranked = flat.join(often, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("s"))
    most = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - (F.col("n") - F.size("s"))
    first = materialize(ranked.where(most > 0).select("node", "n", F.explode(F.slice("s", 1, most.cast("int"))).alias("t")).select("node", "n", F.col("t.h").alias("h")), "alike-first")
    counts = first.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    hot = materialize(counts.where(F.col("k") > BUCKET).select("h"), "alike-hot")

    x = first.join(counts.where(F.col("k") <= BUCKET).select("h"), "h", "left_semi")
    y = x.select("h", F.col("node").alias("other"), F.col("n").alias("m"))
    pairs = x.join(y, "h").where("node < other AND 5 * least(n, m) >= 4 * greatest(n, m)").select("node", "other").distinct()
    there = sets.select(F.col("node").alias("other"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("s").alias("z"))
    both = pairs.join(sets.select("node", F.col("fp").alias("a"), "n", "s"), "node").join(there, "other")
    out = both.where(alike(F.col("n"), F.col("m"), F.size(F.array_intersect("s", "z")))).select("a", "b")

    # Texts that any such shingles connect are searched together, so that each goes once.
    edges = first.join(hot, "h", "left_semi").select(F.col("h").alias("a"), F.col("node").alias("b"))
    searched = sets.join(simhash.components(edges).groupBy("node").agg(F.min("root").alias("root")), "node")
    blocks = searched.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        searched.join(blocks, "root")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp", "n", "s")
    )
    out = out.unionByName(dealt.groupBy("root", "i", "j").applyInPandas(forest, "a long, b long"))
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of ``docs``; all columns stay."""
    own = materialize(rows_of(docs), "alike-rows")
    fps = materialize(own.select("fp").distinct(), "alike-nodes")
    roots = simhash.components(simhash.links(fps).unionByName(links(docs)))
    named = own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("t"))
    named = named.join(roots.withColumnRenamed("node", "at"), F.col("fp") == F.col("at"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("t").alias("t"))
    chosen = named.select(F.col("t.doc_id").alias("kept_id"), F.col("t.node").alias("kept_node"))
    mine = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    copies = own.join(chosen, mine, "left_semi").groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    kept = materialize(copies.select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"), "copies"), "alike-kept")
    marked = docs.withColumn("node", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = marked.join(kept.where("copies = 1"), mine, "left_semi").drop("node")
    again = kept.where("copies > 1")
    if again.isEmpty():
        return out
    return out.unionByName(marked.join(again, mine, "left_semi").dropDuplicates(["doc_id", "node"]).drop("node"))
