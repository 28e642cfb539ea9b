"""Noise of range blocks, wide-band hits, patterns, native Doppler, outlines and smoothed turns against direct versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import geodesy
from echogrid.operators import blocks, geometry, lines, native, neighbours

c = F.col
WIDTH, BLOCKS = 23, 4


def image(seed, lines):
    """Complex noise with gaps: a block without any line, one with a single one, lines with a few bad samples."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(lines, WIDTH)) + 1j * rng.normal(size=(lines, WIDTH))
    z[::4, 0:3] = 0
    z[1::5, 7] = 0
    z[:, 10:15] = 0
    z[3, 10:15] = 1 + 2j
    return z


def cells(spark, images, listed=lambda z: True):
    rows = [(name, r, k, float(z[r, k].real), float(z[r, k].imag)) for name, z in images.items() for r in range(z.shape[0]) for k in range(z.shape[1]) if listed(z[r, k])]
    return spark.createDataFrame(rows, "image string, row long, col int, re double, im double")


def spans():
    size = WIDTH // BLOCKS
    return [(b * size, WIDTH if b == BLOCKS - 1 else (b + 1) * size) for b in range(BLOCKS)]


def good_lines(z, lo, hi, percent):
    part = z[:, lo:hi]
    return part[(np.abs(part) <= 1e-8).mean(axis=1) <= percent / 100]


def by_eigenvalue(z, interval, median):
    n = len(z)
    if n < 2:
        return None
    size = min(interval or min(max(min(n, 3), math.ceil(n / 8)), 100), n)
    powers = []
    for start in range(0, n, size):
        stop = min(start + size, n)
        part = z[stop - size : stop]
        values = np.linalg.eigvalsh(part @ part.conj().T / z.shape[1])
        powers.append(np.median(values[:-1]) if median else values[0])
    return float(np.median(powers))


def by_variance(z, kind):
    if len(z) == 0:
        return None
    if len(z) == 1:
        d, scale = z, 1.0
    elif kind == "single":
        d, scale = z[:-1] - z[-1], 0.5
    elif kind == "diff":
        d, scale = np.diff(z, axis=0), 0.5
    else:
        d, scale = z - z.mean(axis=0), 1.0
    p = np.abs(d) ** 2
    return float(scale * p[np.sqrt(p) < 2 * np.sqrt(p.mean())].mean())


def compare(found, images, want, percent, ends):
    rows = {(r["image"], r["block"]): r for r in found.collect()}
    assert len(rows) == len(images) * BLOCKS
    for name, z in images.items():
        for b, (lo, hi) in enumerate(spans()):
            part = good_lines(z[1:-1] if ends else z, lo, hi, percent)
            r, expected = rows[name, b], want(part)
            assert r["lines"] == len(part)
            assert r["range"] == pytest.approx(1000 + 2 * (lo + hi - 1) / 2)
            assert (r["power"] is None) == (expected is None)
            if expected is not None:
                assert r["power"] == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize(("interval", "median", "ends"), [(None, True, False), (4, False, True), (500, True, False)])
def test_noise_by_eigenvalue(spark, monkeypatch, interval, median, ends):
    monkeypatch.setattr(blocks, "CHUNK", 7)  # lines are numbered over several chunks
    images = {"a": image(1, 45), "b": image(2, 6)}
    found = blocks.noise_by_eigenvalue(cells(spark, images), WIDTH, BLOCKS, 1000.0, 2.0, interval, median, 20.0, ends, keys=("image",))
    compare(found, images, lambda z: by_eigenvalue(z, interval, median), 20.0, ends)


@pytest.mark.parametrize("kind", ["single", "diff", "mean"])
def test_noise_by_variance(spark, kind):
    images = {"a": image(3, 30), "b": image(4, 5)}
    found = blocks.noise_by_variance(cells(spark, images), WIDTH, BLOCKS, 1000.0, 2.0, kind, 20.0, keys=("image",))
    compare(found, images, lambda z: by_variance(z, kind), 20.0, False)


def test_noise_of_cells_that_are_null_or_not_listed(spark):
    images = {"a": image(5, 20)}
    full = cells(spark, images)
    null = full.withColumns({x: F.when((c("re") != 0) | (c("im") != 0), c(x)) for x in ("re", "im")})
    want = {r["block"]: (r["lines"], r["power"]) for r in blocks.noise_by_eigenvalue(full, WIDTH, BLOCKS, 0.0, 1.0, keys=("image",)).collect()}
    for some in (null, cells(spark, images, lambda v: v != 0)):
        got = {r["block"]: (r["lines"], r["power"]) for r in blocks.noise_by_eigenvalue(some, WIDTH, BLOCKS, 0.0, 1.0, keys=("image",)).collect()}
        assert got == {b: (n, pytest.approx(p)) for b, (n, p) in want.items()}


def test_noise_of_an_empty_table(spark):
    none = cells(spark, {"a": image(5, 4)}).where("false")
    assert blocks.noise_by_eigenvalue(none, WIDTH, BLOCKS, 0.0, 1.0, keys=("image",)).count() == 0
    assert [r["power"] for r in blocks.noise_by_variance(none, WIDTH, BLOCKS, 0.0, 1.0).collect()] == [None] * BLOCKS


def hits_of(power, size, z0, trim):
    pulses, width = power.shape
    flags, x = np.zeros((pulses, width), int), np.arange(pulses)
    for i in range(width - size + 1):
        level = np.log10(power[:, i : i + size].mean(axis=1))
        level = level - np.polyval(np.polyfit(x, level, 1), x)
        cut = int(round(trim / 2 * pulses))
        mid = np.sort(level)[cut : pulses - cut]
        flags[:, i] = (level - mid.mean()) / mid.std() > z0
    out = np.zeros_like(flags)
    for i in range(width - size + 1):
        out[:, i] = flags[:, max(0, i - size + 1) : i + 1].sum(axis=1)
    return out


def test_wide_band_hits_are_those_of_a_loop_over_windows(spark):
    rng = np.random.default_rng(6)
    power = {"a": rng.exponential(size=(60, 24)) * np.exp(np.arange(60) / 30)[:, None], "b": rng.exponential(size=(40, 24))}
    power["a"][20:23, 6:16] *= 60  # a burst over ten bins and three pulses
    rows = [(n, r, k, float(p[r, k])) for n, p in power.items() for r in range(p.shape[0]) for k in range(24)]
    df = spark.createDataFrame(rows, "image string, row long, col int, power double")
    found = blocks.wide_band_hits(df, 24, 4, 0.005, 0.1, ("image",))
    got = {(r["image"], r["row"], r["col"]): r["hits"] for r in found.collect()}
    for n, p in power.items():
        want = hits_of(p, 4, 2.5758293035489004, 0.1)
        assert [got[n, r, k] for r in range(p.shape[0]) for k in range(24)] == want.ravel().tolist()
    loud = {(r["row"], r["col"]) for r in blocks.detections(found.where("image = 'a'"), ["hits"], 0.05).where("loud").collect()}
    assert {(r, k) for r in (20, 21, 22) for k in range(8, 13)} <= loud
    with pytest.raises(ValueError):
        blocks.wide_band_hits(df, 24, 25, 0.005, 0.1)


def test_detections_exceed_the_quantile_of_each_image(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 9, 300)
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "id long, a int, b int")
    got = {r["id"] for r in blocks.detections(df, ["a", "b"], 0.1).where("loud").collect()}
    assert got == set(np.flatnonzero((a > np.quantile(a, 0.9)) | (b > np.quantile(b, 0.9))).tolist())


def test_elevation_pattern_of_a_flat_antenna_and_its_fit(spark):
    r0, dr, platform, ground, size, bins = 800_000.0, 30.0, 7.1e6, 6.37e6, 4, 42
    blocks_of, start = bins // size, r0 + 1.5 * dr
    r = start + np.arange(blocks_of) * size * dr
    inc = np.arccos((platform**2 - ground**2 - r**2) / (2 * ground * r))
    look = np.arccos((platform**2 + r**2 - ground**2) / (2 * platform * r))
    shape = -3.0 + 2e3 * (look - look.mean()) - 4e6 * (look - look.mean()) ** 2
    power = 10 ** (shape / 10) / (r / start) ** 3 / (np.tan(inc) / np.tan(inc[0]))
    rows = [(line, k, math.sqrt(power[min(k // size, blocks_of - 1)]), 0.0) for line in range(3) for k in range(bins)]
    df = spark.createDataFrame(rows, "row long, col int, re double, im double")
    p = blocks.elevation_pattern(df, bins, size, r0, dr, platform, ground)
    found = sorted(blocks.smooth_pattern(p, 2).collect(), key=lambda x: x["block"])
    assert [x["block"] for x in found] == list(range(blocks_of))
    assert np.allclose([x["db"] for x in found], shape - shape.max(), atol=1e-6)
    assert np.allclose([x["fitted"] for x in found], shape - shape.max(), atol=1e-5)
    assert np.allclose([x["incidence"] for x in found], inc)
    half = {x["block"]: x["db"] for x in blocks.elevation_pattern(df, bins, size, r0, dr, platform, ground, one_way=True).collect()}
    assert np.allclose([half[b] for b in range(blocks_of)], (shape - shape.max()) / 2, atol=1e-6)


def test_chirp_has_unit_energy_and_its_pedestal():
    z = blocks.raised_cosine_chirp(0.02, 10.0, 1.0, 0.25)
    assert len(z) == 11 and np.linalg.norm(z) == pytest.approx(1)
    assert abs(z[0]) / abs(z[5]) == pytest.approx(0.25) and abs(z[-1]) == pytest.approx(abs(z[0]))


WAVE = 0.24


def circle(spark):
    """A circular orbit over the poles, as states every ten seconds."""
    radius, w = 7.1e6, 7500 / 7.1e6
    turn = [math.radians(60) + w * t for t in np.arange(0, 101, 10)]
    rows = [(1, float(t), radius * math.cos(a), 0.0, radius * math.sin(a), -7500 * math.sin(a), 0.0, 7500 * math.cos(a)) for t, a in zip(np.arange(0, 101, 10), turn, strict=True)]
    return geometry.orbits(spark.createDataFrame(rows, "orbit_id int, t double, px double, py double, pz double, vx double, vy double, vz double"))


def test_native_doppler_places_have_their_range_frequency_and_height(spark):
    rows = [(i, 1, 12.5 + 7 * i, 830_000.0 + 9000 * i, 100.0 * i, 1 if i % 2 else -1, 400.0 * (i - 4)) for i in range(9)]
    rows += [(20, 1, 50.0, 830_000.0, 0.0, 1, 1e6), (21, 1, 500.0, 830_000.0, 0.0, 1, 0.0), (22, 2, 50.0, 830_000.0, 0.0, 1, 0.0)]
    points = spark.createDataFrame(rows, "id long, orbit_id int, t double, r double, h double, side int, doppler double")
    found = {r["id"]: r for r in native.radar_to_ground(native.with_state(points, circle(spark)), WAVE).collect()}
    for i, _, _, r, h, side, f in rows[:9]:
        x = found[i]
        p, v = (np.array([x[f"{a}{k}"] for k in "xyz"]) for a in "pv")
        g = np.array([x[k] for k in "xyz"])
        assert x["r"] == r and np.linalg.norm(g - p) == pytest.approx(r, abs=1e-5)
        assert 2 / WAVE * v @ (g - p) / r == pytest.approx(f, abs=1e-4)
        n = geodesy.A / math.sqrt(1 - geodesy.E2 * math.sin(x["lat"]) ** 2)
        assert math.hypot(g[0], g[1]) / math.cos(x["lat"]) - n == pytest.approx(h, abs=0.02)
        assert np.sign(np.cross(p, v) @ (g - p)) == side  # the left of a track upwards is along the normal of the orbit
    assert all(found[i]["x"] is None for i in (20, 21, 22))


def test_reskew_of_no_doppler_stays_and_of_a_doppler_moves(spark):
    points = spark.createDataFrame([(i, 1, 30.0 + 5 * i, 840_000.0 + 5000 * i, 0.0, 1) for i in range(6)], "id long, orbit_id int, t double, r double, h double, side int")
    for f in (0.0, 600.0):
        table = spark.createDataFrame([(1, r, k, f) for r in range(3) for k in range(3)], "orbit_id int, row long, col int, v double")
        out = native.reskew(points, table, circle(spark), (0.0, 50.0, 800_000.0, 50_000.0), (3, 3), WAVE).collect()
        assert len(out) == 6
        for x in out:
            moved = x["t_zero"] - x["t"]
            assert x["doppler"] == pytest.approx(f)
            if f == 0:
                assert moved == pytest.approx(0, abs=1e-5) and x["r_zero"] == pytest.approx(x["r"], abs=1e-3)
            else:
                # Beams that look ahead see a place before it is abeam.
                assert 0.8 < moved / (x["r"] * f * WAVE / 2 / 7500**2) < 1.2 and x["r_zero"] < x["r"]


def test_track_speeds_of_a_circle(spark):
    points = spark.createDataFrame([(i, 1, 10.0 * i + 3) for i in range(8)], "id long, orbit_id int, t double")
    for x in native.track_speeds(native.with_state(points, circle(spark))).collect():
        assert x["speed"] == pytest.approx(7500, rel=2e-5)
        assert abs(x["heading"]) == pytest.approx(0, abs=1e-6)
        assert x["ground_speed"] == pytest.approx(7500 * 6.36e6 / 7.1e6, rel=0.01) and x["ground_speed"] < x["speed"]


def test_perimeter_runs_around_the_scene_and_bounds_hold_it(spark):
    scenes = spark.createDataFrame([(1, 1, 20.0, 30.0, 830_000.0, 880_000.0, 1, 0.0), (2, 1, 20.0, 30.0, 830_000.0, 880_000.0, -1, 200.0)], "id long, orbit_id int, t0 double, t1 double, r0 double, r1 double, side int, doppler double")
    out = native.perimeter(scenes, circle(spark), 4, [0.0, 2000.0], WAVE)
    rows = out.collect()
    assert len(rows) == 2 * 2 * 12
    areas = set()
    for key in {(r["id"], r["height"]) for r in rows}:
        ring = [(r["lon"], r["lat"]) for r in sorted(rows, key=lambda r: r["k"]) if (r["id"], r["height"]) == key]
        areas.add(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) > 0)
    assert len(areas) == 1  # both looks run the same way
    for b in native.bounds(out, 0.1).collect():
        own = [r for r in rows if r["id"] == b["id"]]
        assert b["west"] == pytest.approx(min(r["lon"] for r in own) - 0.1) and b["north"] == pytest.approx(max(r["lat"] for r in own) + 0.1)
    with pytest.raises(ValueError):
        native.perimeter(scenes, circle(spark), 1, [0.0], WAVE)


def test_bounds_across_the_antimeridian_at_a_pole_and_without_a_place(spark):
    rows = [(1, 179.0, 10.0), (1, -178.5, 12.0), (2, 3.0, 89.9), (2, 5.0, 88.0), (3, None, None), (3, 1.0, 1.0)]
    got = {r["id"]: (r["west"], r["east"], r["south"], r["north"]) for r in native.bounds(spark.createDataFrame(rows, "id long, lon double, lat double"), 0.5).collect()}
    assert got == {1: (178.5, 182.0, 9.5, 12.5), 2: (2.5, 5.5, 87.5, 90.0), 3: (None,) * 4}


def test_planted_turns_are_taken_off_a_smooth_surface(spark):
    y, x = np.mgrid[0:90, 0:40]
    clean = 5 + 0.05 * y + 0.08 * x
    bad = clean.copy()
    bad[60:62, 10:12] += 2 * math.pi
    bad[30, 5] -= 4 * math.pi
    bad[40:45, 20:30] = 0
    rows = [(r, k, None if (r, k) == (80, 3) else float(bad[r, k])) for r in range(90) for k in range(40)]
    kernel = np.exp(-0.5 * (np.arange(-4, 5) / 3) ** 2).tolist()
    out = neighbours.repair_turns_smoothed(spark.createDataFrame(rows, "row long, col int, v double"), "v", kernel, kernel, 3)
    want = clean.copy()
    want[40:45, 20:30] = 0
    got = {(r["row"], r["col"]): r["v"] for r in out.collect()}
    assert got.pop((80, 3)) is None
    assert len(got) == 90 * 40 - 1 and all(v == pytest.approx(want[k]) for k, v in got.items())


@pytest.mark.parametrize("taper", [0.0, 0.3])
def test_common_band_lies_between_both_images_dopplers(spark, taper):
    rng = np.random.default_rng(8)
    rate, n, width = 1000.0, 64, 3
    a, b = (rng.normal(size=(n, width)) + 1j * rng.normal(size=(n, width)) for _ in range(2))
    for k in range(width):
        a[:, k] += 9 * np.exp(2j * np.pi * (0.1 + 0.05 * k) * np.arange(n))
        b[:, k] += 9 * np.exp(2j * np.pi * (0.2 - 0.02 * k) * np.arange(n))
    frames = [spark.createDataFrame([(r, k, float(z[r, k].real), float(z[r, k].imag)) for r in range(n) for k in range(width)], "row long, col int, re double, im double") for z in (a, b)]
    got = {(r["image"], r["block"], r["line"]): np.array(r["re"]) + 1j * np.array(r["im"]) for r in lines.azimuth_common_band(*frames, 400.0, rate, taper, 40).collect()}
    assert len(got) == 2 * 2 * width
    mids = [np.mean([np.angle((z[1:, k] * z[:-1, k].conj()).mean()) * rate / (2 * np.pi) for z in (a, b)]) for k in range(width)]
    for i, z in enumerate((a, b)):
        for blk, part in enumerate((z[:40], z[40:])):
            f = np.fft.fftfreq(len(part), 1 / rate)
            for k in range(width):
                d, edge = np.abs(f - mids[k]), 200.0 * taper
                w = np.array([1.0 if x <= 200 - edge else 0.5 * (1 + math.cos(math.pi * (x - 200 + edge) / (2 * edge))) if x <= 200 + edge else 0.0 for x in d])
                assert np.allclose(got[i, blk, k], np.fft.ifft(np.fft.fft(part[:, k]) * w))
