"""Footprint polygons, orbits of several states, splines, resampling with a carrier, fine offsets, tones, spectra and eigenvalue thresholds against direct versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import asof, footprint, grid, lines, mapping, neighbours, stats
from echogrid.plans import registry

c = F.col


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def cells_of(spark, z, complex_=False):
    rows = [(int(r), int(k), *((float(z[r, k].real), float(z[r, k].imag)) if complex_ else (float(z[r, k]),))) for r in range(z.shape[0]) for k in range(z.shape[1])]
    return frame(spark, rows, "row long, col int, re double, im double" if complex_ else "row long, col int, v double")


def test_a_name_is_registered_once():
    registry.load()
    with pytest.raises(ValueError):
        registry.query("a16_facet_areas")(lambda spark, sf: None)


# Polygons


def clipped(polygon, y0, x0):
    """The area of a polygon within one cell, by cutting it at the cell's four sides."""
    p = list(polygon)
    for axis, bound, sign in ((0, y0, 1), (0, y0 + 1, -1), (1, x0, 1), (1, x0 + 1, -1)):
        out = []
        for a, b in zip(p, [*p[1:], *p[:1]], strict=True):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                u = da / (da - db)
                out.append((a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])))
        p = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], *p[:1]], strict=True))) / 2 if p else 0.0


def quads(seed, n=25):
    rng = np.random.default_rng(seed)
    out = [((0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)), ((1.0, 1.0), (1.0, 1.0), (3.5, 2.0), (1.5, 3.0)), ((0.2, 0.2), (0.2, 3.7), (0.9, 3.7), (0.9, 0.2)), ((0.0, 0.0), (3.0, 3.0), (0.0, 6.0), (1.0, 3.0))]
    for _ in range(n):
        turn = np.sort(rng.uniform(0, 2 * math.pi, 4)) + rng.uniform(0, 6)
        size, at = rng.uniform(0.2, 4, 2), rng.uniform(-3, 9, 2)
        out.append(tuple((float(at[0] + size[0] * math.cos(t)), float(at[1] + size[1] * math.sin(t))) for t in turn))
    return out


def test_cell_shares_are_the_areas_of_the_overlaps(spark):
    polygons = quads(3)
    df = frame(spark, [(k, *itertools.chain(*p)) for k, p in enumerate(polygons)] + [(99, None, *([0.0] * 7))], "id long, y0 double, x0 double, y1 double, x1 double, y2 double, x2 double, y3 double, x3 double")
    corners = [(c(f"y{i}"), c(f"x{i}")) for i in range(4)]
    got = {(r.id, r.row, r.col): r.share for r in footprint.cell_shares(df, corners).collect()}
    assert 99 not in {k[0] for k in got}
    for k, p in enumerate(polygons):
        ys, xs = [a for a, _ in p], [b for _, b in p]
        expected = {(k, y, x): clipped(p, y, x) for y in range(math.floor(min(ys)), math.ceil(max(ys)) + 1) for x in range(math.floor(min(xs)), math.ceil(max(xs)) + 1)}
        for at, area in expected.items():
            assert got.get(at, 0.0) == pytest.approx(area, abs=1e-9)
    whole = df.where("id < 99").select("id", footprint.polygon_area(corners).alias("a"))
    for r in whole.collect():
        assert sum(v for k, v in got.items() if k[0] == r.id) == pytest.approx(r.a, abs=1e-9)


def test_projection_by_area(spark):
    rng = np.random.default_rng(8)
    image = rng.random((12, 12))
    polygons = [p for p in quads(5, 40) if all(0 <= v <= 12 for q in p for v in q)] + [((-1.0, 2.0), (-1.0, 4.0), (2.0, 4.0), (2.0, 2.0)), ((1.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0))]
    df = frame(spark, [(k, *itertools.chain(*p)) for k, p in enumerate(polygons)], "id long, y0 double, x0 double, y1 double, x1 double, y2 double, x2 double, y3 double, x3 double")
    got = {r.id: r for r in footprint.project_by_area(df, [(c(f"y{i}"), c(f"x{i}")) for i in range(4)], cells_of(spark, image), ["id"], ["v"]).collect()}
    for k, p in enumerate(polygons[:-2]):
        w = np.array([[clipped(p, y, x) for x in range(12)] for y in range(12)])
        assert got[k].weight == pytest.approx(w.sum(), abs=1e-8)
        assert got[k].v == pytest.approx((w * image).sum() / w.sum(), abs=1e-6)
        assert got[k].looks == pytest.approx(w.sum() ** 2 / (w**2).sum(), rel=1e-5)
    assert got[len(polygons) - 2].v is None and got.get(len(polygons) - 1) is None


def test_facets_by_overlap_keep_their_areas(spark):
    p = [q for q in quads(11) if len(set(q)) == 4]
    df = frame(spark, [(k, 1.0 + k, 0.5 + k, *itertools.chain(*q)) for k, q in enumerate(p)], "row long, sigma double, gamma double, y0 double, x0 double, y1 double, x1 double, y2 double, x2 double, y3 double, x3 double").withColumn("col", F.lit(0))
    total = mapping.area_layers_by_overlap(df, [(c(f"y{i}"), c(f"x{i}")) for i in range(4)], ()).agg(F.sum("sigma"), F.sum("gamma")).first()
    assert total[0] == pytest.approx(sum(1.0 + k for k in range(len(p))), rel=1e-6) and total[1] == pytest.approx(sum(0.5 + k for k in range(len(p))), rel=1e-6)


# Orbits


@pytest.mark.parametrize("method,degree,irregular", [("hermite", 7, 1.0), ("legendre", 8, 0.0)])
def test_polynomial_orbits_are_exact(spark, method, degree, irregular):
    rng = np.random.default_rng(degree)
    p = np.polynomial.Polynomial(rng.normal(size=degree + 1), domain=[0, 20], window=[-1, 1])
    v = p.deriv() if method == "hermite" else np.polynomial.Polynomial(rng.normal(size=degree + 1), domain=[0, 20], window=[-1, 1])
    t = np.arange(14) * 1.5 + irregular * rng.uniform(-0.5, 0.5, 14)
    states = frame(spark, [(1, float(a), float(p(a)), float(v(a))) for a in t] + [(2, float(a), 0.0, 0.0) for a in range(3)], "orbit int, t double, p double, v double")
    asked = sorted({*rng.uniform(t[0], t[-1], 60).tolist(), *t.tolist()}) + [float(t[0]) - 1, float(t[-1]) + 1]
    times = frame(spark, [(1, a) for a in asked] + [(2, 1.5)], "orbit int, t double")
    got = {r.t: (r.p, r.v) for r in asof.orbit_at(times, states, ["orbit"], {"p": "v"}, method).collect()}
    assert sorted(got) == asked[:-2]
    for a, (x, y) in got.items():
        assert x == pytest.approx(p(a), abs=1e-9) and y == pytest.approx(v(a), abs=1e-9)


# Interpolation


def natural_spline(y, at):
    n = len(y)
    m = np.zeros((n, n))
    m[0, 0] = m[-1, -1] = 1
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = 1, 4, 1
    second = np.linalg.solve(m, np.concatenate([[0], 6 * (y[2:] - 2 * y[1:-1] + y[:-2]), [0]]))
    i = int(at)
    u = at - i
    return y[i] + u * (y[i + 1] - y[i] - second[i] / 3 - second[i + 1] / 6 + u * (second[i] / 2 + u * (second[i + 1] - second[i]) / 6))


def test_biquintic_is_a_spline_of_six_by_six_cells(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(14, 15))
    places = [(k, float(y), float(x)) for k, (y, x) in enumerate([*rng.uniform(1, 9, (30, 2)), (4.0, 5.0), (3.25, 6.0)])] + [(99, 0.5, 4.0)]
    got = {r.id: r.v for r in grid.interpolate(frame(spark, places, "id long, y double, x double"), cells_of(spark, z), [], "biquintic").collect()}
    for k, y, x in places[:-1]:
        i, j = math.floor(y) - 1, math.floor(x) - 1
        rows = np.array([natural_spline(z[i + a, j : j + 6], x - j) for a in range(6)])
        assert got[k] == pytest.approx(natural_spline(rows, y - i), abs=1e-9)
    assert got[99] is None


def test_resampling_keeps_a_polynomial_carrier(spark):
    terms = {(0, 1): 2.1, (1, 0): -2.6, (1, 1): 0.03, (2, 0): 0.01, (0, 2): -0.02}
    y, x = np.mgrid[0:24, 0:26].astype(float)
    phase = lambda y, x: sum(v * y**i * x**j for (i, j), v in terms.items())
    slow = lambda y, x: (1 + 0.1 * np.cos(0.3 * y) + 0.2 * np.sin(0.25 * x)) * np.exp(1j * 0.2 * np.sin(0.2 * y))
    places = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.random.default_rng(2).uniform(4, 18, (40, 2)))]
    d = mapping.resample(frame(spark, places, "id long, y double, x double"), cells_of(spark, slow(y, x) * np.exp(1j * phase(y, x)), True), [], terms)
    got = {r.id: complex(r.re, r.im) for r in d.collect()}
    for k, a, b in places:
        assert abs(got[k] - slow(a, b) * np.exp(1j * phase(a, b))) < 0.02


# Offsets


def smooth_image(rng, n, y=0.0, x=0.0):
    """Band-limited noise, moved by y and x cells."""
    f = np.fft.fftfreq(n)
    s = np.fft.fft2(rng.normal(size=(n, n))) * np.exp(-((f[:, None] ** 2 + f[None, :] ** 2) / 0.02))
    return np.fft.ifft2(s * np.exp(-2j * np.pi * (f[:, None] * y + f[None, :] * x))).real


@pytest.mark.parametrize("y,x", [(0.0, 0.0), (1 / 16, -3 / 16), (1 + 5 / 16, -2 + 7 / 16), (-1.5, 0.125)])
def test_planted_shifts_are_found_to_a_sixteenth(spark, y, x):
    a, b = smooth_image(np.random.default_rng(4), 64), smooth_image(np.random.default_rng(4), 64, y, x)
    got = lines.track(cells_of(spark, a), cells_of(spark, b), 20, 4, step=14).collect()
    assert len(got) == 4 * 4 - 7 or len(got) >= 4
    for r in got:
        assert abs(r.dy - y) <= 1 / 16 and abs(r.dx - x) <= 1 / 16
        assert r.peak > 0.98 and r.snr > 2 and 0 <= r.var_y < 0.1 and 0 <= r.var_x < 0.1


def test_correlation_and_covariance_directly():
    rng = np.random.default_rng(3)
    ref, search = rng.normal(size=(5, 6)), rng.normal(size=(9, 11))
    got = lines.correlation(ref, search)
    for y, x in itertools.product(range(5), range(6)):
        assert got[y, x] == pytest.approx(np.corrcoef(ref.ravel(), search[y : y + 5, x : x + 6].ravel())[0, 1], abs=1e-9)
    y, x = np.mgrid[-3:4, -3:4].astype(float)
    surface = 0.9 - 0.02 * y**2 - 0.05 * x**2 + 0.01 * y * x
    curve = 30 * np.array([[0.04, 0.01], [0.01, 0.1]])
    inverse = np.linalg.inv(curve)
    expected = 2 * 0.1 * inverse + 0.1**2 * 30 / 2 * inverse @ inverse
    assert lines.peak_covariance(surface, 3, 3, 30) == pytest.approx((expected[0, 0], expected[1, 1], expected[0, 1]))
    assert lines.peak_covariance(surface, 0, 3, 30) == (lines.UNSURE, lines.UNSURE, 0.0)


# Tones, spectra, eigenvalues


def test_tone_of_varying_strength_is_removed(spark):
    n = np.arange(200)
    quiet = 0.01 * np.cos(2 * np.pi * 0.31 * n)
    tone = (2 + np.sin(n / 90)) * np.exp(2j * np.pi * 0.12 * n)
    line = [(1, (quiet + tone).real.tolist(), tone.imag.tolist()), (2, quiet.tolist(), [0.0] * 200)]
    got = {r.row: np.array(r.re) + 1j * np.array(r.im) for r in lines.remove_tone(frame(spark, line, "row long, re array<double>, im array<double>"), ["row"], 0.12, 32).collect()}
    assert np.abs(got[1] - quiet)[16:-16].max() < 0.05 and np.abs(got[2] - quiet).max() < 0.01


@pytest.mark.parametrize("doppler", [300.0, -2150.0])
def test_planted_doppler_is_found_beyond_half_the_rate(spark, doppler):
    """A target whose Doppler grows with the wavelength: phase steps between lines differ over the range spectrum."""
    rng, rate, carrier, n = np.random.default_rng(6), 1500.0, 20.0, 64
    f = (np.arange(n) - n // 2) / n
    base = np.fft.fftshift(np.fft.fft(rng.normal(size=n) + 1j * rng.normal(size=n)))
    pulses = [np.fft.ifft(np.fft.ifftshift(base * np.exp(2j * np.pi * doppler / rate * k * (1 + f / carrier)))) for k in range(40)]
    z = frame(spark, [(k, p.real.tolist(), p.imag.tolist()) for k, p in enumerate(pulses)], "row long, re array<double>, im array<double>")
    phase = stats.lag_doppler(lines.to_cells(lines.spectra(z, ["row"]), ["row"]), ["col"], 2 * math.pi).select("col", c("doppler").alias("phase"))
    got = stats.spectral_slope(phase, n, 0.375, rate, carrier).first()
    assert got.doppler == pytest.approx(doppler, rel=1e-6) and got.bins == 48


def test_eigenvalues_noise_and_thresholds(spark):
    rng, interval, block = np.random.default_rng(9), 5, 5
    z = rng.normal(size=(20 * interval + 2, 40)) + 1j * rng.normal(size=(20 * interval + 2, 40))
    z[35:70] += 8 * np.exp(2j * np.pi * 0.2 * np.arange(40)) * rng.normal(size=(35, 1))
    df = frame(spark, [(k, r.real.tolist(), r.imag.tolist()) for k, r in enumerate(z)], "row long, re array<double>, im array<double>")
    e = lines.eigenvalues(df, interval).where(F.size("values") == interval).cache()
    direct = [np.linalg.eigvalsh(z[k * interval : (k + 1) * interval] @ z[k * interval : (k + 1) * interval].conj().T / 40)[::-1] for k in range(20)]
    one, mid = stats.noise_by_interval(e, interval, 0.8).first(), stats.noise_by_interval(e, interval, median=True).first()
    assert one.intervals == 20 and one.power == pytest.approx(0.8 * np.median([d[-1] for d in direct]))
    assert mid.power == pytest.approx(np.median([np.median(d[1:]) for d in direct]))
    t = {r.block: r for r in stats.eigenvalue_threshold(e, block, 2, 3).collect()}
    loud = {r.k: r.loud for r in stats.loud_eigenvalues(e, stats.eigenvalue_threshold(e, block, 2, 3), block, 3).collect()}
    assert sorted(t) == [0, 1, 2, 3] and sorted(loud) == list(range(20))
    for b in t:
        db = 10 * np.log10(np.array(direct[b * block : (b + 1) * block]))
        top = db[:, np.argmax(db[:, :2].std(axis=0))]
        low = np.diff(db[:, 3])
        ratio = np.diff(top).std() / low.std()
        threshold = low.mean() + np.interp(ratio, [2, 20], [5, 2]) * low.std()
        assert t[b].ratio == pytest.approx(ratio) and t[b].threshold == pytest.approx(threshold)
        for k, row in enumerate(db):
            hit = np.flatnonzero(np.diff(row)[:3] < -threshold)
            assert loud[b * block + k] == (hit[-1] + 1 if len(hit) else 0)
    assert any(loud[k] for k in range(7, 14))


# Holes


def test_pyramid_fill_directly(spark):
    rng = np.random.default_rng(12)
    layers = rng.random((3, 90, 30))
    layers[0, 10:45, 5:20] = np.nan
    layers[1, 15:40, 8:18] = np.nan
    layers[2, 22:35, 10:16] = np.nan
    rows = [(int(r), int(k), *(None if np.isnan(v) else float(v) for v in layers[:, r, k])) for r in range(90) for k in range(30)]
    got = np.full((90, 30), np.nan)
    for r in neighbours.fill_pyramid(frame(spark, rows, "row long, col int, v double, a double, b double"), "v", ["a", "b"], 1, 2).collect():
        got[r.row, r.col] = r.v

    def mean(z):
        out = np.full(z.shape, np.nan)
        for y, x in itertools.product(range(z.shape[0]), range(z.shape[1])):
            near = z[max(y - 1, 0) : y + 2, max(x - 2, 0) : x + 3]
            out[y, x] = near[~np.isnan(near)].mean() if (~np.isnan(near)).any() else np.nan
        return out

    v = layers[0]
    for z in layers[1:]:
        v = np.where(np.isnan(v), mean(z), v)
    while np.isnan(v).any():
        v = np.where(np.isnan(v), mean(v), v)
    assert np.abs(got - v).max() < 1e-9


def test_block_functions_see_their_halo(spark):
    """A three by three mean over blocks is that of the whole image, whatever the blocks are."""
    z = np.random.default_rng(2).random((23, 18))

    def mean3(b):
        p = np.pad(b, 1, constant_values=np.nan)
        return np.nanmean(np.lib.stride_tricks.sliding_window_view(p, (3, 3)), axis=(2, 3))

    for rows, cols in ((5, 7), (64, 64)):
        got = np.full(z.shape, np.nan)
        for r in footprint.map_blocks(cells_of(spark, z), mean3, rows, cols, 1).collect():
            got[r.row, r.col] = r.v
        assert np.abs(got - mean3(z)).max() < 1e-12


def test_points_in_a_table_of_polygons(spark):
    polygons = quads(21, 8)
    points = np.random.default_rng(6).uniform(-6, 12, (300, 2))
    p = frame(spark, [(k, [{"y": a, "x": b} for a, b in q]) for k, q in enumerate(polygons)], "polygon long, corners array<struct<y: double, x: double>>")
    got = {(r.id, r.polygon): r.inside for r in footprint.within(frame(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(points)], "id long, y double, x double"), p, 2.5, 0.5).collect()}
    for k, (y, x) in enumerate(points):
        for j, q in enumerate(polygons):
            edges = list(zip(q, [*q[1:], q[0]], strict=True))
            inside = sum(((a[0] > y) != (b[0] > y)) and x < (b[1] - a[1]) * (y - a[0]) / (b[0] - a[0]) + a[1] for a, b in edges) % 2 == 1
            far = []
            for a, b in edges:
                d = np.subtract(b, a)
                u = min(max(float(np.dot((y - a[0], x - a[1]), d) / max(np.dot(d, d), 1e-300)), 0), 1)
                far.append(math.hypot(y - a[0] - u * d[0], x - a[1] - u * d[1]))
            assert ((k, j) in got) == (inside or min(far) <= 0.5)
            if (k, j) in got:
                assert got[k, j] == inside
