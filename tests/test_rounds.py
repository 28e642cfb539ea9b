"""The ionosphere chain runs few jobs, however far components reach; few links and many give the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.operators import asof, components, lines, looks, pipelines
from echogrid.plans import registry

registry.load()
c = F.col


def counted(monkeypatch, *modules):
    """The names of tables that are written from now on."""
    from echogrid import shared

    names = []

    def write(df, name):
        names.append(name)
        return shared.materialize(df, name)

    for m in modules:
        monkeypatch.setattr(m, "materialize", write)
    return names


def regions(m, eight):
    """Least cell of each cell's component, by flooding."""
    out = np.full(m.shape, -1)
    for i, j in np.argwhere(m):
        if out[i, j] < 0:
            todo = [(i, j)]
            out[i, j] = i * m.shape[1] + j
            while todo:
                a, b = todo.pop()
                for u, v in ((u, v) for u in (-1, 0, 1) for v in (-1, 0, 1) if eight or not u or not v):
                    y, x = a + u, b + v
                    if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and out[y, x] < 0:
                        out[y, x] = out[i, j]
                        todo.append((y, x))
    return out


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("links", [components.LINKS, 0])
def test_components_over_seams_of_blocks(spark, monkeypatch, eight, links):
    """Blocks of 64 lines, joined where they touch: winding paths up and down, and cells of both ends of neighbouring lines apart."""
    monkeypatch.setattr(components, "CELLS", 64)
    monkeypatch.setattr(components, "LINKS", links)
    m = np.random.default_rng(5).random((210, 9)) > (0.55 if eight else 0.4)
    m[:200, 1:8:2], m[:200, 0:9:2] = True, False
    m[199, 1:4], m[0, 3:6] = True, True
    cells = spark.createDataFrame([(int(i), int(j), bool(m[i, j])) for i in range(210) for j in range(9)], "row long, col int, m boolean")
    want = regions(m, eight)
    got = {(r.row, r.col): r.label for r in components.label(cells, c("m"), 9, eight).collect()}
    assert got == {(int(i), int(j)): int(want[i, j]) for i, j in np.argwhere(m)}
    # Lines before the first one, too.
    up = {(r.row + 1000, r.col): r.label + 9000 for r in components.label(cells.withColumn("row", c("row") - 1000), c("m"), 9, eight).collect()}
    assert up == got


def test_a_long_component_takes_no_rounds(spark, monkeypatch):
    names = counted(monkeypatch, components)
    cells = spark.range(6000).select(c("id").alias("row"), F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("col")).where("col = row % 4 OR col = 0")
    assert components.label(cells, F.lit(True), 4).select("label").distinct().count() == 1
    assert len(names) <= 3


@pytest.mark.parametrize("links", [components.LINKS, 0])
def test_few_links_and_many_give_the_same(spark, monkeypatch, links):
    monkeypatch.setattr(components, "LINKS", links)
    rng = np.random.default_rng(8)
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 60, (90, 2)) if p[0] != p[1]})
    df = spark.createDataFrame([(a, b, float(rng.integers(1, 9))) for a, b in pairs], "a long, b long, d2 double")
    edges = sorted(((r.d2, r.a, r.b) for r in df.collect()))
    group, tree = list(range(60)), []
    for d, a, b in edges:
        if group[a] != group[b]:
            tree.append((a, b, d))
            group = [group[a] if g == group[b] else g for g in group]
    assert sorted((r.a, r.b, r.d2) for r in components.spanning_bridges(df).collect()) == sorted(tree)
    least = {k: group.index(group[k]) for k in {x for p in pairs for x in p}}
    assert {r.node: r.root for r in components.united(df.select("a", "b")).collect()} == least
    own, other = rng.integers(-5, 6, (2, 60))
    turns = spark.createDataFrame([(a, b, float(own[a] - own[b]), float(other[a] - other[b])) for a, b, _ in tree], "a long, b long, s double, t double")
    got = components.tree_turns(turns, spark.range(60).withColumnRenamed("id", "label"), ["s", "t"]).collect()
    assert len(got) == 60
    for r in got:
        k = least.get(r.label, r.label)
        assert (r.root, r.s, r.t) == (k, own[k] - own[r.label], other[k] - other[r.label])


@pytest.mark.parametrize("links", [components.LINKS, 0])
def test_no_links_at_all(spark, monkeypatch, links):
    monkeypatch.setattr(components, "LINKS", links)
    none = spark.createDataFrame([], "a long, b long, d2 double, turns double")
    assert components.united(none).count() == 0 and components.spanning_bridges(none).count() == 0
    assert [(r.label, r.root, r.turns) for r in components.tree_turns(none, spark.range(1).withColumnRenamed("id", "label")).collect()] == [(0, 0, 0.0)]


def test_two_phases_are_unwrapped_at_once(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(k, i, j, *map(float, rng.uniform(-3, 3, 2))) for k in (0, 1) for i in range(40) for j in range(6)], "k int, row long, col long, p double, q double")
    both = {(r.k, r.row, r.col): (r.p, r.q) for r in asof.unwrapped_tiles(p, ["k"], ["p", "q"], 16, 3).collect()}
    one = [{(r.k, r.row, r.col): r[x] for r in asof.unwrapped_tiles(p, ["k"], x, 16, 3).collect()} for x in "pq"]
    assert both == {k: (one[0][k], one[1][k]) for k in one[0]} and len(both) == 480


@pytest.mark.parametrize("width,block", [(32, (5, 2)), (22, (3, 4)), (9, (4, 1))])
def test_bands_in_one_pass_are_those_of_cells(spark, width, block):
    """Sums of line pairs against both bands cell by cell, with lines that one image lacks and a shorter one."""
    rng = np.random.default_rng(width)
    image = lambda rows: spark.createDataFrame([(r, k, *map(float, rng.normal(size=2))) for r in rows for k in range(width - 4 * (r == 7))], "row long, col int, re double, im double")
    a, b = image([*range(-1, 9), *range(11, 31)]), image(range(-1, 28))
    got = {(r.row, r.col): r for r in pipelines.sub_bands(a, b, block).collect()}
    for name, low, high in (("low", -0.5, 0.0), ("high", 0.0, 0.5)):
        half = [lines.to_cells(lines.band(lines.to_lines(x, ["row"]), ["row"], low, high, step=2), ["row"]) for x in (a, b)]
        z = cplx.mean(cplx.pair("i"))
        power = F.sqrt(F.avg(cplx.power(cplx.pair())) * F.avg(cplx.power(cplx.pair("b"))))
        want = looks.multilook(looks.interferogram(*half).where("row >= 0"), *block, (28, width // 2), coherence=F.hypot(*z) / power, phase=F.atan2(z[1], z[0])).collect()
        assert len(want) == len(got) > 0
        for r in want:
            assert got[r.row, r.col][name] == pytest.approx(r.phase, abs=1e-9) and got[r.row, r.col][f"{name}_coherence"] == pytest.approx(r.coherence)


def test_the_chain_writes_few_tables(spark, monkeypatch):
    names = counted(monkeypatch, asof, components, pipelines)
    d = registry.QUERIES["l6_ionosphere_bridged"](spark, "/root/testdata/sf0.001")
    assert d.count() == 792 and len(names) <= 30
