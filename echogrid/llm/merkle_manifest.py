"""Merkle manifest of a table of documents, with a proof for each row (operator 13).

A leaf is the digest of a row. Leaves of a source ascend by id; every ``FANOUT`` consecutive
nodes become the digest of their digests until one is left, the source's subroot; subroots,
ordered by source, form the tree above them likewise.

Slot pivot: a level is one aggregation by (tree, position div ``FANOUT``) whose conditional
aggregates spread the children into columns ``c0, c1, c2``. Their concatenation is hashed to
the parent; the columns without a child's own are its siblings. Proofs go down the same
tables: a parent hands its path to its children, so a join at a level is over parents, and
the last one over a third of the leaves. A path holds the siblings before and after a node on
each level, from the leaf up; folding a leaf along it recomputes the root.

Positions come from a range partitioning by (source, id, leaf): a hot source is spread over
many tasks, and what goes through the driver is nothing but the number of levels.

Rows: a null value is written as ``-``, so null and empty differ. Ids that are null come first;
of equal ids the smaller leaf, and repeated rows each have a leaf and a proof. A null id is
not tampered with. An empty table gives an empty result. A source of one row is its own subroot,
and so is the root of one source. Columns other than the five are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.shared import materialize

FANOUT = 3
#: Columns of a row that its leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before: string, after: string>>"


def written(value: Column) -> Column:
    """A value as the leaf's digest reads it: its UTF-8 byte count, a colon and the value, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, tampered``: digests of the rows as they are, and as they read after the tampering (null: the same)."""
    covers = lambda text: digest(*(written(text if c == "text" else F.col(c)) for c in COVERED))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    meant = even & F.col("text").contains("\n")
    cut = F.when(meant, covers(F.translate("text", "\n", "")))
    return docs.select("doc_id", "source", covers(F.col("text")).alias("leaf"), cut.alias("tampered"))


def numbered(df: DataFrame, tree: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its tree, and ``size``, the rows of that tree.

    Rows are sorted over all partitions; only the first place of a tree in each partition
    and its rows there are aggregated, one row a partition and tree.
    """
    keys = [F.col(tree), *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    laid = materialize(laid, name).withColumn("block", F.shiftright("at", 33))
    runs = laid.groupBy(tree, "block").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    every = Window.partitionBy(tree)
    before = F.sum("rows").over(every.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(tree, "block", (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero"), F.sum("rows").over(every).alias("size"))
    return laid.join(starts, [tree, "block"]).select(*df.columns, (F.col("at") - F.col("zero")).alias("pos"), "size")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Tables of parents, lowest first: ``tree, pos, size, hash`` and the children's ``c0, c1, c2``.

    ``nodes`` holds ``tree, pos, size, child``, a struct with the field ``hash``. A tree whose
    nodes are one is at its top and does not go on.
    """
    out = []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        slot = [F.max(F.when(F.col("pos") % FANOUT == k, F.col("child"))).alias(f"c{k}") for k in range(FANOUT)]
        up = nodes.where("size > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size")).agg(*slot)
        up = materialize(up.withColumn("hash", digest(*(F.coalesce(f"c{k}.hash", F.lit("")) for k in range(FANOUT)))), f"{name}-{len(out)}")
        out.append(up)
        nodes = up.select("tree", "pos", "size", F.struct("hash").alias("child"))
        most = -(-most // FANOUT)
    return out


def proofs(tops: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """``tree, pos, child, path`` and what else ``tops`` holds, for the children of the lowest level.

    ``tops`` has ``tree`` and ``path``, the rest of the way from the top of each tree; its
    trees of one node only are not among the children.
    """
    other = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for table in reversed(parents):
        started = table.where("size = 1").join(tops, "tree")
        known = started if above is None else started.unionByName(table.where("size > 1").join(above, ["tree", "pos"]))
        kids = []
        for k in range(FANOUT):
            hashes = [F.coalesce(f"c{j}.hash", F.lit("")) for j in range(FANOUT)]
            step = F.struct(F.concat(F.lit(""), *hashes[:k]).alias("before"), F.concat(F.lit(""), *hashes[k + 1 :]).alias("after"))
            kids.append(F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(f"c{k}").alias("child"), F.concat(F.array(step), F.col("path")).alias("path")))
        below = known.select("tree", *other, F.explode(F.array(*kids)).alias("x")).where("x.child IS NOT NULL")
        below = below.select("tree", "x.pos", "x.child", "x.path", *other)
        above = below.drop("child")
    return below


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    # A key that is never null, so joins by it are plain ones; '-' stands before '=', so keys are in the order of sources, null first.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    # Written first: the sampling for the ranges reads digests, not texts.
    own = materialize(leaves(docs).withColumn("tree", key), "merkle-digests")
    own = numbered(own, "tree", [F.col("doc_id"), F.col("leaf")], "merkle-leaves")
    nodes = own.select("tree", "pos", "size", F.struct(F.col("leaf").alias("hash"), "doc_id", "tampered").alias("child"))
    trees = levels(nodes, "merkle-tree")

    # Sources of one row are their own subroots.
    single = nodes.where("size = 1").select("tree", "child.hash")
    subroots = single
    for table in trees:
        subroots = subroots.unionByName(table.where("size = 1").select("tree", "hash"))
    crown = numbered(subroots.withColumn("all", F.lit(0)), "all", [F.col("tree")], "merkle-subroots")
    crown = crown.select(F.col("all").alias("tree"), "pos", "size", F.struct("hash", F.col("tree").alias("key")).alias("child"))
    crown = materialize(crown, "merkle-crown")
    upper = levels(crown, "merkle-top")
    no_path = F.expr(f"cast(array() AS {_PATH})").alias("path")
    if upper:
        tops = proofs(upper[-1].select("tree", F.col("hash").alias("root"), no_path), upper)
    else:
        tops = crown.select("tree", "pos", "child", no_path, F.col("child.hash").alias("root"))
    tops = materialize(tops.select(F.col("child.key").alias("tree"), "path", F.col("child.hash").alias("subroot"), "root"), "merkle-tops")

    lone = nodes.where("size = 1").join(tops, "tree").select("child", "path", "subroot", "root")
    out = lone if not trees else lone.unionByName(proofs(tops, trees).select("child", "path", "subroot", "root"))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    fold = F.aggregate("path", F.coalesce("child.tampered", "child.hash"), lambda acc, x: digest(x["before"], acc, x["after"]))
    out = out.select("child.doc_id", F.col("child.hash").alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS k, doc_id, source, lang, n_chars, CAST(text AS VARCHAR) AS text,
    list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda acc, b:
        list_reduce([xor(acc, b)] || [CAST(x AS BIGINT) FOR x IN range(8)], lambda r, x: xor(r >> 1, (r & 1) * 3988292384))) AS crc FROM documents),
cut AS (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM docs),
spelt AS (SELECT k, doc_id, source, text, other, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head FROM cut),
leaf AS (SELECT k, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS tampered FROM spelt),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM leaf),
low AS (SELECT 0 AS level, source, pos, size, leaf AS hash FROM placed
    UNION ALL SELECT any_value(level) + 1, source, pos // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM low WHERE size > 1 GROUP BY source, pos // 3),
tops AS (SELECT source, level AS height, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (SELECT 0 AS level, pos, size, subroot AS hash FROM tops
    UNION ALL SELECT any_value(level) + 1, pos // 3, any_value((size + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY pos // 3),
steps AS (SELECT p.k, n.level, string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos < p.pos // CAST(power(3, n.level) AS BIGINT)) AS before, string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos > p.pos // CAST(power(3, n.level) AS BIGINT)) AS after
    FROM placed p JOIN low n ON n.source IS NOT DISTINCT FROM p.source AND n.size > 1 AND n.pos // 3 = p.pos // CAST(power(3, n.level + 1) AS BIGINT) GROUP BY p.k, n.level
    UNION ALL SELECT p.k, t.height + n.level, string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos < t.pos // CAST(power(3, n.level) AS BIGINT)), string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos > t.pos // CAST(power(3, n.level) AS BIGINT))
    FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN high n ON n.size > 1 AND n.pos // 3 = t.pos // CAST(power(3, n.level + 1) AS BIGINT) GROUP BY p.k, t.height, n.level),
fold AS (SELECT k, 0 AS level, tampered AS hash FROM placed
    UNION ALL SELECT k, fold.level + 1, sha256(coalesce(before, '') || hash || coalesce(after, '')) FROM fold JOIN steps USING (k) WHERE steps.level = fold.level),
folded AS (SELECT k, arg_max(hash, level) AS folded_root FROM fold GROUP BY k),
proof AS (SELECT k, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY level)) AS proof FROM steps GROUP BY k)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops t ON t.source IS NOT DISTINCT FROM placed.source CROSS JOIN (SELECT hash AS root FROM high WHERE size = 1) JOIN folded USING (k) LEFT JOIN proof USING (k)
"""
