"""Operators without SQL against numpy, and edge cases of those with it."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import radar
from echogrid.operators import asof, components, fit, geometry, intervals, lines, looks, neighbours, stats
from echogrid.sources import rasters


def raster(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(a)], "row long, col int, v double")


def image(spark, z):
    return spark.createDataFrame([(int(i), [float(x) for x in r.real], [float(x) for x in r.imag]) for i, r in enumerate(z)], "row long, re array<double>, im array<double>")


def back(df):
    r = sorted(df.collect(), key=lambda x: x.row)
    return np.array([np.array(x.re) + 1j * np.array(x.im) for x in r])


def test_multilook_drops_the_rest_and_weights_of_zero_are_null(spark):
    a = np.arange(35.0).reshape(5, 7)
    got = looks.multilook(raster(spark, a), 2, 3, (5, 7), v=F.avg("v"))
    want = a[:4, :6].reshape(2, 2, 2, 3).mean(axis=(1, 3))
    assert {(r.row, r.col): r.v for r in got.collect()} == {(i, j): want[i, j] for i in range(2) for j in range(2)}
    got = looks.multilook(raster(spark, a), 2, 3, (5, 7), v=looks.weighted(F.col("v"), F.when(F.col("row") < 2, 0.0).otherwise(1.0)))
    assert {r.row for r in got.collect() if r.v is None} == {0}


def test_stats_of_one_and_of_missing_cells(spark):
    r = raster(spark, np.array([[np.nan, 3.0]])).agg(*stats.real_stats(F.col("v"))).first()
    assert (r.n, r.mean, r.sd) == (1, 3.0, 0.0)
    r = raster(spark, np.array([[1.0, 2.0, 4.0]])).agg(*stats.real_stats(F.col("v"))).first()
    assert r.sd == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_coherence_of_an_image_with_itself_is_one(spark):
    z = spark.range(40).select((F.col("id") % 5).alias("row"), F.floor(F.col("id") / 5).cast("int").alias("col"), F.sin("id").alias("re"), F.cos(F.col("id") * 3).alias("im"))
    t = looks.interferogram(z, z).groupBy().agg(looks.coherence((F.col("re"), F.col("im")), (F.col("bre"), F.col("bim"))).alias("c")).first()
    assert t.c == pytest.approx(1.0)


def test_subswath_takes_the_first_and_is_half_open(spark):
    cells = spark.createDataFrame([(0, k) for k in range(6)] + [(1, 0)], "row long, col int")
    swaths = spark.createDataFrame([(0, 2, 1, 5), (0, 1, 2, 4), (0, 3, 5, 5)], "row long, s int, start int, stop int")
    got = {(r.row, r.col): r.s for r in intervals.subswath(cells, swaths).collect()}
    assert got == {(0, 0): 0, (0, 1): 2, (0, 2): 1, (0, 3): 1, (0, 4): 2, (0, 5): 0, (1, 0): 0}


def test_latest_survey_at_and_before_the_epoch(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    s = spark.createDataFrame([("a", 1, day(1)), ("a", 2, day(5)), ("a", 3, day(5)), ("b", 4, day(9))], "id string, k int, d timestamp_ntz")
    at = lambda n: {r.id: r.k for r in asof.latest_before(s, ["id"], "d", F.lit(day(n)).cast("timestamp_ntz"), "k").collect()}
    assert at(4) == {"a": 1}
    assert at(5) == {"a": 2}
    assert at(9) == {"a": 2, "b": 4}


def test_asof_keeps_nulls_of_the_last_state(spark):
    e = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 9.0), (2, 3.0)], "k int, t double")
    s = spark.createDataFrame([(1, 1.0, 7.0), (1, 5.0, None)], "k int, t double, v double")
    assert sorted((r.k, r.t, r.v) for r in asof.asof(e, s, ["k"], ["v"]).collect() if r.t != 9.0) == [(1, 0.5, None), (1, 1.0, 7.0), (2, 3.0, None)]


def test_convolution_pads_with_zeros(spark):
    a = np.random.default_rng(1).normal(size=(5, 6))
    k = np.array([0.25, 0.5, 0.25])
    want = np.zeros((5, 6))
    p = np.pad(a, 1)
    for i in range(5):
        for j in range(6):
            want[i, j] = (p[i : i + 3, j : j + 3] * np.outer(k, k)).sum()
    got = neighbours.smooth(raster(spark, a), ["v"], list(k), list(k))
    assert all(r.v == pytest.approx(want[r.row, r.col]) for r in got.collect())


def test_residue_of_a_vortex(spark):
    y, x = np.mgrid[0:4, 0:4] - 1.5
    p = raster(spark, np.arctan2(y, x)).withColumnRenamed("v", "p")
    got = {(r.row, r.col): r.charge for r in neighbours.residues(p, "p").collect()}
    assert abs(got[1, 1]) == 1 and sum(map(abs, got.values())) == 1


def test_unwrapping_a_line(spark):
    phase = np.linspace(0, 30, 40)
    df = spark.createDataFrame([(0, k, float(np.angle(np.exp(1j * p)))) for k, p in enumerate(phase)], "row int, col int, p double")
    got = [r.unwrapped for r in asof.unwrapped(df, ["row"], "col", "p").orderBy("col").collect()]
    assert np.allclose(got, np.unwrap(np.angle(np.exp(1j * phase))))


@pytest.mark.parametrize("eight", [True, False])
def test_components(spark, eight):
    rng = np.random.default_rng(3)
    m = rng.random((12, 15)) > 0.55
    got = {(r.row, r.col): r.label for r in components.label(raster(spark, m.astype(float)), F.col("v") > 0, 15, eight).collect()}
    seen, want = {}, {}
    for i, j in zip(*np.nonzero(m), strict=True):
        if (i, j) in seen:
            continue
        todo, members = [(i, j)], []
        seen[i, j] = 1
        while todo:
            a, b = todo.pop()
            members.append((a, b))
            for u in (-1, 0, 1):
                for v in (-1, 0, 1):
                    q = a + u, b + v
                    if (eight or not u or not v) and 0 <= q[0] < 12 and 0 <= q[1] < 15 and m[q] and q not in seen:
                        seen[q] = 1
                        todo.append(q)
        for q in members:
            want[int(q[0]), int(q[1])] = min(int(a * 15 + b) for a, b in members)
    assert got == want


def test_spanning_bridges(spark):
    pairs = [(1, 2, 4.0), (2, 3, 1.0), (1, 3, 9.0), (4, 5, 2.0)]
    df = spark.createDataFrame(pairs, "a long, b long, d2 double")
    assert sorted((r.a, r.b) for r in components.spanning_bridges(df).collect()) == [(1, 2), (2, 3), (4, 5)]


def test_robust_fit_drops_planted_outliers(spark):
    rng = np.random.default_rng(5)
    u, v = rng.random(60), rng.random(60)
    y = 1 + 2 * u - 3 * v + rng.normal(0, 0.01, 60)
    y[[7, 30]] += 5
    t = spark.createDataFrame([(0, k, *map(float, r)) for k, r in enumerate(zip(u, v, y, strict=True))], "g int, id int, u double, v double, y double")
    kept, k = fit.robust_surface(t, ["g"], "y", fit.plane_terms(F.col("u"), F.col("v"), 1), F.lit(1.0), 3.5, 5)
    assert {7, 30}.isdisjoint(r.id for r in kept.collect())
    r = k.first()
    assert np.allclose([r.k0, r.k1, r.k2], [1, 2, -3], atol=0.05)


def test_spectral_operators(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=(6, 32)) + 1j * rng.normal(size=(6, 32))
    chirp = np.exp(1j * 0.1 * np.arange(5) ** 2)
    df = image(spark, z)
    for mode in ("full", "valid", "same"):
        want = np.array([np.convolve(r, np.conj(chirp[::-1]), mode) for r in z])
        assert np.allclose(back(lines.compress(df, ["row"], chirp, mode)), want)
    assert np.allclose(back(lines.shift(df.withColumn("by", F.lit(3)), ["row"], "by")), np.roll(z, 3, axis=1))
    assert np.allclose(back(lines.upsample(df, ["row"], 2))[:, ::2], z)
    low, high = lines.band(df, ["row"], 0.0, 0.4999, False), lines.band(df, ["row"], -0.5, -0.0001, False)
    assert np.allclose(back(low) + back(high), z)


def test_interference_removal(spark):
    rng = np.random.default_rng(9)
    z = 0.1 * (rng.normal(size=(16, 64)) + 1j * rng.normal(size=(16, 64)))
    tone = 5 * np.exp(1j * (0.7 * np.arange(64)[None, :] + rng.random(16)[:, None]))
    got = back(lines.remove_loud(image(spark, z + tone), 16, 2, 10.0))
    assert np.abs(got).std() < 0.2


def test_offset_tracking_finds_a_planted_shift(spark):
    a = np.random.default_rng(11).normal(size=(48, 48))
    got = lines.offsets(raster(spark, a), raster(spark, np.roll(a, (2, -1), (0, 1))), 16, 3).collect()
    assert {(r.dy, r.dx) for r in got if r.wy == 1 and r.wx == 1} == {(2, -1)}


def test_radar_and_ground_are_inverse(spark):
    ids = spark.createDataFrame([(0,)], "orbit_id int")
    orbit = geometry.straight_orbits(spark, ids, 6, 10.0, (F.lit(7071000.0), F.lit(0.0), F.lit(0.0)), (0.0, 7500.0, 0.0))
    t = spark.createDataFrame([(0, 6371000.0, 60000.0, 200000.0), (0, 6371000.0, 9e9, 0.0)], "orbit_id int, x double, y double, z double")
    r = {x.y: x for x in geometry.ground_to_radar(t, orbit).collect()}
    assert r[60000.0].t == pytest.approx(8.0) and r[9e9].t is None
    p = spark.createDataFrame([(7071000.0, 60000.0, 0.0, 0.0, 7500.0, 0.0, r[60000.0].r, 0.0)], "px double, py double, pz double, vx double, vy double, vz double, r double, h double")
    g = geometry.radar_to_ground(p, float(np.hypot(6371000.0, np.hypot(60000.0, 200000.0)))).first()
    assert (g.x, g.y, abs(g.z)) == (pytest.approx(6371000.0), pytest.approx(60000.0), pytest.approx(200000.0))


def test_trihedral_at_boresight(spark):
    k = 3**-0.5
    r = spark.range(1).select(radar.trihedral_rcs(F.lit(k), F.lit(k), F.lit(k), F.lit(1.0), 0.24).alias("t"), radar.trihedral_rcs(F.lit(k), F.lit(k), F.lit(k), F.lit(1.0), 0.24, True).alias("s")).first()
    assert r.t == pytest.approx(4 * np.pi / 3 / 0.24**2) and r.s == pytest.approx(12 * np.pi / 0.24**2)


def test_raster_files(spark, tmp_path):
    cells = raster(spark, np.arange(6.0).reshape(2, 3)).withColumn("raster_id", F.lit("a"))
    rasters.write(cells, str(tmp_path / "r"), {"x0": 1.0, "dx": 2.0})
    got, axis = rasters.read(spark, str(tmp_path / "r"))
    assert axis == {"x0": 1.0, "dx": 2.0} and sorted((r.row, r.col, r.v) for r in got.collect()) == sorted((r.row, r.col, r.v) for r in cells.collect())
    rasters.append_stats(cells, str(tmp_path / "s"), "v")
    assert spark.read.parquet(str(tmp_path / "s")).first().n == 6


def test_partition_count_does_not_matter(spark):
    from echogrid.plans import registry

    registry.load()
    one = registry.QUERIES["a6_coherence"](spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    many = registry.QUERIES["a6_coherence"](spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(one) == sorted(many)


def test_two_rasters_in_one_table_stay_apart(spark):
    """Neighbourhood operators keyed by the image give for each what they give for it alone, across block edges too."""
    from echogrid.operators import neighbours as nb

    rng = np.random.default_rng(8)
    v = {r: rng.normal(size=(150, 7)) for r in "ab"}
    rows = [(r, i, j, float(x), bool(x > 0)) for r in v for (i, j), x in np.ndenumerate(v[r])]
    both = spark.createDataFrame(rows, "raster_id string, row long, col int, v double, f boolean").withColumn("v", F.when(F.col("v") > -1, F.col("v")))
    k = [0.25, 0.5, 0.25]
    jobs = {
        "smooth": lambda d, keys: nb.smooth(d, ["v"], [0.1, 0.2, 0.4, 0.2, 0.1], k, keys=keys).select("row", "col", "v", *keys),
        "median": lambda d, keys: nb.median(d, "v", 2, 1, keys=keys).select("row", "col", "median", *keys),
        "fill": lambda d, keys: nb.fill_mean(d, "v", 1, 1, 3, keys).select("row", "col", "v", *keys),
        "count": lambda d, keys: nb.count_near(d, F.col("f"), 3, 2, "n", keys).select("row", "col", "n", *keys),
        "open": lambda d, keys: nb.opened(d, F.col("f"), keys=keys).select("row", "col", "opened", *keys),
        "turns": lambda d, keys: nb.repair_turns(d.withColumn("v", F.col("v") * 9), "v", 1, 1, 2, keys).select("row", "col", "v", *keys),
        "residues": lambda d, keys: nb.residues(d.withColumn("v", F.col("v") * 3), "v", keys).select("row", "col", "charge", *keys),
    }
    show = lambda x: None if x is None else round(float(x), 9)
    for name, job in jobs.items():
        together = {(r[3], r[0], r[1]): show(r[2]) for r in job(both, ("raster_id",)).collect()}
        apart = {(one, r[0], r[1]): show(r[2]) for one in "ab" for r in job(both.where(F.col("raster_id") == one), ()).collect()}
        assert together == apart and len(together) == 2100, name
    padded = np.pad(v["a"] > 0, ((3, 3), (2, 2)))
    n = {(r.row, r.col): r.n for r in jobs["count"](both.where("raster_id = 'a'"), ()).collect()}
    assert all(n[i, j] == padded[i : i + 7, j : j + 5].sum() for i in range(150) for j in range(7))
