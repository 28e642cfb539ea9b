"""SimHash near-duplicate groups with pigeonring filtering (operator 3).

A fingerprint is cut into four ring segments of 16 bits. If two fingerprints differ in at
most three bits, then, from some segment on, the differences summed over 1, 2, 3 and 4
consecutive segments stay within 3/4, 6/4, 9/4 and 12/4, so within 0, 1, 2 and 3. That chain
is the index: the first segment agrees; and either the whole second segment agrees, or one
half of the second and one half of the third do. These are 20 keys of 32 bits a fingerprint.
Pairs that share a key pass the chain of budgets before the full Hamming check.

Equal fingerprints are one node. Keys with at most ``BUCKET`` nodes are joined with
themselves; a key with more goes to a breadth-first search that compares each node with the
nodes not reached yet and emits a spanning forest, so n nodes give at most n - 1 links, in
blocks of ``BLOCK`` nodes. No link between components is lost and none is capped.

Rows: a null text is an empty one (fingerprint zero). Rows with a null id keep their row and
their group; they never give a group its id unless all its ids are null. Repeated ids and
rows each keep a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, id_text, map_slices
from echogrid.operators.components import graph_components as components
from echogrid.shared import materialize

SEED, BITS, WORDS = 42, 3, 3
#: Nodes of one key that a plain self-join may pair; more go to the search.
BUCKET = 24
#: Nodes in one block of the search.
BLOCK = 8192
#: Shingles that are hashed at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> bytes:
    """The 64-bit fingerprint, most significant byte first."""
    found = text.lower().split()
    n = len(found)
    if n == 0:
        return bytes(8)
    if n < words:
        return xxhash.xxh64_digest(b" ".join(found), SEED)
    digest, total, ones = xxhash.xxh64_digest, n - words + 1, np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = found[at : at + CHUNK + words - 1]
        hashed = b"".join([digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(words)), strict=False)])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > total).tobytes()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp``: one row per document, the fingerprint as a signed long."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join([fingerprint(x, words) for x in byte_texts(batch)]), ">i8").astype(np.int64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

        return each

    return map_slices(id_text(docs), make, "doc_id long, fp long")


def rotated(fp: Column, start: int) -> Column:
    """The fingerprint with ring segment ``start`` in front."""
    return fp if start == 0 else F.shiftleft(fp, 16 * start).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * start))


def chain_keys(nodes: DataFrame) -> DataFrame:
    """``key, ring``: the 20 keys of each node with the fingerprint turned to the chain's start."""
    bits = lambda r, at, n: F.shiftrightunsigned(r, 64 - at - n).bitwiseAND(F.lit((1 << n) - 1))
    both, turns = [], [rotated(F.col("fp"), s) for s in range(4)]
    for s, r in enumerate(turns):
        first = F.shiftleft(bits(r, 0, 16), 16)
        kinds = [bits(r, 16, 16)] + [F.shiftleft(bits(r, a, 8), 8).bitwiseOR(bits(r, b, 8)) for a in (16, 24) for b in (32, 40)]
        for k, rest in enumerate(kinds):
            both.append(F.struct(F.lit((s * 5 + k) << 32).bitwiseOR(first).bitwiseOR(rest).alias("key"), r.alias("ring")))
    return nodes.select(F.inline(F.array(*both)))


def in_chain(diff: Column) -> Column:
    """The budgets of 1 to 4 consecutive segments, the full Hamming check last."""
    return (F.shiftrightunsigned(diff, 48) == 0) & (F.bit_count(F.shiftrightunsigned(diff, 32)) <= 1) & (F.bit_count(F.shiftrightunsigned(diff, 16)) <= 2) & (F.bit_count(diff) <= BITS)


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the nodes of one key (or pair of blocks) within three bits."""
    left = np.unique(group["ring"].to_numpy(np.int64)).view(np.uint64)
    parents, children = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            for at in range(0, len(front), 256):
                if not len(left):
                    break
                some = front[at : at + 256]
                near = np.bitwise_count(some[:, None] ^ left[None, :]) <= BITS
                hit = near.any(axis=0)
                if hit.any():
                    parents.append(some[near[:, hit].argmax(axis=0)])
                    children.append(left[hit])
                    found.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(found) if found else left[:0]
    a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (parents, children))
    start = int(group["key"].iloc[0]) >> 32
    return pd.DataFrame({"start": np.full(len(a), start // 5, np.int32), "ring1": a, "ring2": b})


def links(nodes: DataFrame) -> DataFrame:
    """``a > b``: links that join the same fingerprints as all pairs within three bits do."""
    keys = chain_keys(nodes)
    counts = keys.groupBy("key").count()
    hot = materialize(counts.where(F.col("count") > BUCKET), "simhash-hot")
    x = keys.join(hot, "key", "left_anti")
    y = x.select("key", F.col("ring").alias("ring2"))
    cold = x.join(y, "key").where((F.col("ring") < F.col("ring2")) & in_chain(F.col("ring").bitwiseXOR(F.col("ring2"))))
    pairs = cold.select(F.floor(F.shiftright("key", 32) / 5).cast("int").alias("start"), F.col("ring").alias("ring1"), "ring2")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = (
        keys.join(hot, "key")
        .withColumn("n", blocks)
        .withColumn("own", F.pmod(F.xxhash64("ring"), F.col("n")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", "ring", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    pairs = pairs.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(forest, "start int, ring1 long, ring2 long"))

    def back(name: str) -> Column:
        out = F.col(name)
        for s in (1, 2, 3):
            out = F.when(F.col("start") == s, rotated(F.col(name), 4 - s)).otherwise(out)
        return out

    return pairs.select(back("ring1").alias("p"), back("ring2").alias("q")).select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``."""
    own = materialize(fingerprints(docs, words), "simhash")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(groups, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
