"""Connected components of masks and graphs, and bridges between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions.radar import TAU
from echogrid.operators.neighbours import across, along, blocked, owned
from echogrid.shared import materialize

#: Cells of the blocks that are labelled in one task each.
CELLS = 1 << 13
#: Links between components (never cells) that one task takes; a graph of more goes in rounds of joins.
LINKS = 1 << 14


def graph_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges: the smallest node that it reaches.

    Large-star and small-star rounds: each links a node's neighbours to their smallest one, so
    a path shrinks by a constant factor a round. Every round is written to the shared folder.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    before = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark.n == 0:
            return e.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("root")).distinct()
        before = mark
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        e = materialize(small.distinct(), "components")


def united(edges: DataFrame) -> DataFrame:
    """As ``graph_components``, for numbers: up to ``LINKS`` edges are united in one task, more of them in rounds."""
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    if e.count() > LINKS:
        return graph_components(e)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=np.int64), *parts])
        node, at = np.unique(p[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"node": node, "root": node[_least(len(node), at[:, 0], at[:, 1])]})

    return e.coalesce(1).mapInPandas(run, "node long, root long")


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges between a and b."""
    root = np.arange(n)
    while True:
        new, least = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def label(cells: DataFrame, flag: Column, width: int, eight: bool = True) -> DataFrame:
    """``row, col, label`` of the cells with the flag: label is the least ``row * width + col`` of the component.

    Components of blocks of some ``CELLS`` cells (whole lines, 64 at least) are found in one task each. They are the nodes of
    the graph, and where the last line of a block touches the first one of the next is an edge, so the
    graph grows with the blocks, not with the cells, and no way through it is longer than the blocks.
    """
    reach, tall = int(eight), max(64, CELLS // max(width, 1))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        row, col = g["row"].to_numpy(np.int64), g["col"].to_numpy(np.int64)
        # A line of keys is one longer than its cells, so that the last of a line is not beside the first of the next.
        line = int(col.max() - col.min()) + 2
        key, at = np.unique((row - row.min()) * line + col - col.min(), return_inverse=True)
        ends = [(np.flatnonzero(key[k % len(key)] == key + step), k) for step in ((1, line - 1, line, line + 1) if eight else (1, line)) for k in [np.searchsorted(key, key + step)]]
        a, b = np.concatenate([i for i, _ in ends]), np.concatenate([k[i] for i, k in ends])
        first = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(first, at.ravel(), row * width + col)
        return g[["row", "col"]].assign(label=first[_least(len(key), a, b)][at.ravel()])

    kinds = dict(cells.dtypes)
    flagged = cells.where(flag).where("row IS NOT NULL AND col IS NOT NULL").select("row", "col", F.floor(F.col("row") / tall).alias("_b"))
    own = materialize(flagged.groupBy("_b").applyInPandas(run, f"row {kinds['row']}, col {kinds['col']}, label long"), "regions")
    beside = F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach))
    last = own.where(F.pmod(F.col("row") + 1, F.lit(tall)) == 0).select((F.col("row") + 1).alias("row"), beside.alias("col"), F.col("label").alias("a"))
    first = own.where(F.pmod(F.col("row"), F.lit(tall)) == 0).select("row", "col", F.col("label").alias("b"))
    roots = united(last.join(first, ["row", "col"])).withColumnRenamed("node", "label")
    return own.join(roots, "label", "left").select("row", "col", F.coalesce("root", "label").alias("label"))


def large_enough(labels: DataFrame, least: int) -> DataFrame:
    """Only the components of so many cells."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(sizes, "label", "left_semi")


def edge_cells(labels: DataFrame) -> DataFrame:
    """The cells of which a neighbour along a line or a column is of no or another component: no other cell is nearest to anything."""
    same = lambda w, k: F.coalesce(F.lag("label", k).over(w) == F.col("label"), F.lit(False)) & (F.abs(F.lag("_at", k).over(w) - F.col("_at")) == 1)
    d = blocked(labels.withColumn("_at", F.col("col")), 1)
    inner = same(along(), 1) & same(along(), -1)
    d = d.withColumn("_in", F.coalesce(inner, F.lit(False))).withColumn("_at", F.col("row"))
    d = owned(d.withColumn("_inner", F.col("_in") & F.coalesce(same(across(), 1) & same(across(), -1), F.lit(False))))
    return d.where(~F.col("_inner")).drop("_at", "_in", "_inner")


def closest_pairs(labels: DataFrame, reach: int, roots: DataFrame | None = None) -> DataFrame:
    """``a < b, ar, ac, br, bc, d2``: the closest cells of every two components within ``reach`` of each other.

    ``roots`` (``label, root``): the closest of every two roots, with the labels of its ends. Cells of one
    side are boxed by tiles of a quarter of the reach. Boxes come first: of two sides only those pairs of boxes
    are opened that may hold a pair as close as the farthest cells of some pair of boxes are, so a wide
    reach compares boxes, not all cells within it.
    """
    who = "label" if roots is None else "root"
    p = labels if roots is None else labels.join(roots, "label")
    side = max(reach // 4, 1)
    p = p.select(F.col(who).alias("w"), "label", "row", "col", F.floor(F.col("row") / side).alias("ty"), F.floor(F.col("col") / side).alias("tx"))
    boxes = p.groupBy("w", "ty", "tx").agg(F.min("row").alias("y0"), F.max("row").alias("y1"), F.min("col").alias("x0"), F.max("col").alias("x1"))
    wide = reach // side + 1
    names = ("w", "ty", "tx", "y0", "y1", "x0", "x1")
    block = lambda k: F.floor(F.col(k) / wide)
    around = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    left = boxes.select(*(F.col(n).alias(f"p{n}") for n in names), block("ty").alias("by"), block("tx").alias("bx"))
    right = boxes.withColumn("_y", F.explode(around)).withColumn("_x", F.explode(around))
    right = right.select(*(F.col(n).alias(f"q{n}") for n in names), (block("ty") + F.col("_y")).alias("by"), (block("tx") + F.col("_x")).alias("bx"))
    both = left.join(right, ["by", "bx"]).where("pw < qw").drop("by", "bx")
    apart = lambda k: F.greatest(F.col(f"p{k}0") - F.col(f"q{k}1"), F.col(f"q{k}0") - F.col(f"p{k}1"), F.lit(0))
    span = lambda k: F.greatest(F.col(f"p{k}1") - F.col(f"q{k}0"), F.col(f"q{k}1") - F.col(f"p{k}0"))
    both = both.withColumns({"least": apart("y") ** 2 + apart("x") ** 2, "most": span("y") ** 2 + span("x") ** 2}).where(F.col("least") <= reach * reach)
    bound = both.groupBy("pw", "qw").agg(F.min("most").alias("bound"))
    open_ = both.join(bound, ["pw", "qw"]).where("least <= bound").select("pw", "pty", "ptx", "qw", "qty", "qtx")
    ends = lambda k, label, r, c: p.select(F.col("w").alias(f"{k}w"), F.col("ty").alias(f"{k}ty"), F.col("tx").alias(f"{k}tx"), F.col("label").alias(label), F.col("row").alias(r), F.col("col").alias(c))
    near = open_.join(ends("p", "a", "ar", "ac"), ["pw", "pty", "ptx"]).join(ends("q", "b", "br", "bc"), ["qw", "qty", "qtx"])
    near = near.withColumn("d2", (F.col("ar") - F.col("br")) ** 2 + (F.col("ac") - F.col("bc")) ** 2).where(F.col("d2") <= reach * reach)
    if roots is not None:
        # Roots may be in the other order than their labels.
        turn = F.col("a") > F.col("b")
        swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
        near = near.select("pw", "qw", "d2", *(swap(x, y).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ar", "br"), ("br", "ar"), ("ac", "bc"), ("bc", "ac"))))
        best = near.groupBy("pw", "qw").agg(F.min(F.struct("d2", "a", "b", "ar", "ac", "br", "bc")).alias("t"))
        return best.select("t.a", "t.b", "t.d2", "t.ar", "t.ac", "t.br", "t.bc")
    return near.groupBy("a", "b").agg(F.min(F.struct("d2", "ar", "ac", "br", "bc")).alias("t")).select("a", "b", "t.*")


def bridges(labels: DataFrame, reach: int) -> DataFrame:
    """A minimum spanning tree over all components of ``labels``, however far apart.

    Pairs are sought within ``reach``, then within twice that among what is not connected yet, and
    so on. A link that a wider search finds is longer than all those found before, so none of the
    tree's is missed. Only cells at the edges of components are compared, and of each two parts of what is
    connected so far one link is kept.
    """
    labels = materialize(edge_cells(labels), "labels")
    ends = labels.agg(F.max("row") - F.min("row"), F.max("col") - F.min("col")).first()
    span = max(int(v or 0) for v in ends) + 1
    names = materialize(labels.select("label").distinct().withColumn("root", F.col("label")), "roots")
    roots, found = names, None
    while True:
        near = materialize(closest_pairs(labels, reach, roots), "pairs")
        found = near if found is None else found.unionByName(near)
        merged = united(found).select(F.col("node").alias("label"), F.col("root").alias("to"))
        roots = materialize(names.select("label").join(merged, "label", "left").select("label", F.coalesce("to", "label").alias("root")), "roots")
        if reach > span or roots.select("root").distinct().limit(2).count() < 2:
            return spanning_bridges(found)
        reach *= 2


def spanning_bridges(pairs: DataFrame) -> DataFrame:
    """A minimum spanning forest of ``a, b, d2`` links, by Boruvka rounds: each component takes its shortest way out. Up to ``LINKS`` links are gone through in one task, by length."""
    pairs = materialize(pairs, "pairs")
    if pairs.count() <= LINKS:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(parts)
            if parts:
                p = pd.concat(parts).sort_values(["d2", "a", "b"], ignore_index=True)
                ends, kept = np.unique(p[["a", "b"]].to_numpy(), return_inverse=True)[1].reshape(-1, 2).tolist(), []
                up = list(range(2 * len(p)))

                def top(k: int) -> int:
                    while up[k] != k:
                        up[k] = up[up[k]]
                        k = up[k]
                    return k

                for a, b in ends:
                    ra, rb = top(a), top(b)
                    kept.append(ra != rb)
                    up[ra] = rb
                yield p[kept]

        return pairs.coalesce(1).mapInPandas(run, pairs.schema)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    chosen = None
    while True:
        ra = nodes.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = nodes.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = materialize(pairs.join(ra, "a").join(rb, "b").where("ra <> rb"), "open")
        if open_.isEmpty():
            return chosen if chosen is not None else pairs.limit(0)
        ways = open_.withColumn("root", F.explode(F.array("ra", "rb")))
        # Ties by the pair itself, so that rounds never close a ring.
        best = ways.groupBy("root").agg(F.min(F.struct("d2", "a", "b")).alias("t")).select("t.a", "t.b").distinct()
        picked = open_.join(best, ["a", "b"], "left_semi")
        chosen = picked.drop("ra", "rb") if chosen is None else chosen.unionByName(picked.drop("ra", "rb"))
        merged = united(picked.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        nodes = materialize(nodes.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "nodes")


def bridge_turns(bridges: DataFrame, phase: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """``bridges`` with ``turns``: whole turns by which the phase at b's end misses that at a's end (halves away from 0). ``values``: from each phase to the name of its turns."""
    values = {"phase": "turns"} if values is None else values
    at = lambda r, k, end: phase.select(F.col("row").alias(r), F.col("col").alias(k), *(F.col(v).alias(f"_{end}{v}") for v in values))
    d = bridges.join(at("ar", "ac", "a"), ["ar", "ac"]).join(at("br", "bc", "b"), ["br", "bc"])
    d = d.withColumns({t: F.round((F.col(f"_a{v}") - F.col(f"_b{v}")) / TAU) for v, t in values.items()})
    return d.drop(*(f"_{end}{v}" for end in "ab" for v in values))


def tree_turns(edges: DataFrame, labels: DataFrame, turns: Sequence[str] = ("turns",)) -> DataFrame:
    """``label, root`` and ``turns``: whole turns to add to each component so that all of a tree agree with its least label, ``root``.

    ``edges`` (``a, b`` and ``turns``): what b needs to agree with a. Up to ``LINKS`` edges are gone along in one task. Of more,
    each round every group draws heads or
    tails by a hash; a group with tails that has an edge to one with heads goes to it, and its turns
    move by what that edge wants. So rounds grow with the logarithm of the components, however long the tree's
    branches are, and each is a join and an aggregate, written to the shared folder.
    """
    edges = materialize(edges.select("a", "b", F.array(*(F.coalesce(t, F.lit(0.0)).cast("double") for t in turns)).alias("turns")), "edges")
    named = lambda v: [F.get(v, F.lit(k)).alias(t) for k, t in enumerate(turns)]
    plus = lambda v, w: F.zip_with(v, w, lambda x, y: x + y)
    less = lambda v, w: F.zip_with(v, w, lambda x, y: x - y)
    nodes = labels.select("label").distinct()
    if edges.count() <= LINKS:
        there = [nodes.select(F.col("label").alias(k)) for k in "ab"]
        found = edges.join(there[0], "a").join(there[1], "b").select("a", "b", "turns").coalesce(1).mapInPandas(_along, "label long, root long, turns array<double>")
        d = nodes.join(found, "label", "left")
        return d.select("label", F.coalesce("root", "label").alias("root"), *named(F.coalesce("turns", F.array(*[F.lit(0.0)] * len(turns)))))
    nodes, draw = materialize(nodes.select("label", F.col("label").alias("root"), F.array(*[F.lit(0.0)] * len(turns)).alias("turns")), "turns"), 0
    own = lambda k: nodes.select(F.col("label").alias(k), F.col("root").alias(f"r{k}"), F.col("turns").alias(f"t{k}"))
    while True:
        open_ = edges.join(own("a"), "a").join(own("b"), "b").where("ra <> rb").select("ra", "rb", less(plus("turns", "ta"), "tb").alias("by"))
        open_ = materialize(open_, "open")
        if open_.isEmpty():
            break
        ways = open_.unionByName(open_.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), F.transform("by", lambda x: -x).alias("by")))
        heads = lambda k: F.pmod(F.xxhash64(k, F.lit(draw)), F.lit(2)) == 0  # noqa: B023, E731
        hooks = ways.where(~heads("rb") & heads("ra")).groupBy(F.col("rb").alias("root")).agg(F.min(F.struct("ra", "by")).alias("to"))
        moved = nodes.join(hooks, "root", "left").select("label", F.coalesce("to.ra", "root").alias("root"), F.coalesce(plus("turns", "to.by"), "turns").alias("turns"))
        nodes, draw = materialize(moved, "turns"), draw + 1
    least = nodes.groupBy("root").agg(F.min(F.struct("label", "turns")).alias("first"))
    return nodes.join(least, "root").select("label", F.col("first.label").alias("root"), *named(less("turns", "first.turns")))


def _along(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From all edges ``a, b, turns`` to ``label, root, turns``: trees are gone along from their least label."""
    ways: dict[int, list] = {}
    for p in parts:
        for a, b, t in zip(p["a"].tolist(), p["b"].tolist(), p["turns"], strict=True):
            ways.setdefault(a, []).append((b, t))
            ways.setdefault(b, []).append((a, -t))
    done: dict[int, tuple[int, np.ndarray]] = {}
    for k in sorted(ways):
        if k not in done:
            done[k], todo = (k, 0 * ways[k][0][1]), [k]
            while todo:
                at = todo.pop()
                for to, t in ways[at]:
                    if to not in done:
                        done[to] = k, done[at][1] + t
                        todo.append(to)
    if done:
        yield pd.DataFrame({"label": np.array(list(done), np.int64), "root": np.array([r for r, _ in done.values()], np.int64), "turns": [t for _, t in done.values()]})


def bridged(labels: DataFrame, phase: DataFrame, reach: int, tree: DataFrame | None = None, values: Sequence[str] = ("phase",)) -> DataFrame:
    """``row, col, label`` and the phases ``values``, each component's with the whole turns off by which it misses the others across their bridges."""
    tree = bridges(labels, reach) if tree is None else tree
    names = {v: f"{v}_turns" for v in values}
    turns = tree_turns(bridge_turns(tree, phase, names), labels, list(names.values()))
    d = labels.join(turns.drop("root"), "label").join(phase, ["row", "col"])
    return d.select("row", "col", "label", *((F.col(v) + TAU * F.col(t)).alias(v) for v, t in names.items()))
