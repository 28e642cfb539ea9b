"""Fits, components and spectral operators (A29 to A37, J27, G)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.operators import components, fit, footprint, lines, neighbours, stats
from echogrid.plans import relations as rel
from echogrid.plans.registry import SQL, query, r6
from echogrid.plans.relations import with_relations
from echogrid.shared import materialize

c = F.col


@query("a29_line_fit", "tie", "SELECT scene % 50 AS layer, count(*) AS n, round(regr_intercept(dl, line), 8) + 0.0 AS k0, round(regr_slope(dl, line), 10) + 0.0 AS k1 FROM tie GROUP BY 1")
def a29(spark, sf):
    t = rel.tie(spark, sf).withColumn("layer", c("scene") % 50)
    k = fit.solve(t, ["layer"], fit.powers(c("line"), 1), c("dl"))
    return k.select("layer", "n", (F.round("k0", 8) + F.lit(0.0)).alias("k0"), (F.round("k1", 10) + F.lit(0.0)).alias("k1"))


@query("a30_robust_surface")
def a30(spark, sf):
    t = rel.tie(spark, sf).withColumn("layer", c("scene") % 20)
    terms = fit.plane_terms((c("line") - 1000) / 1000, (c("pixel") - 50) / 50, 1)
    kept, _ = fit.robust_surface(t, ["layer"], "dl", terms, c("corr"), 1.5, 3)
    return kept.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.stddev_pop("residual"), 9).alias("sd"))


@query("a37_ramp_removal", "img", ", b AS (SELECT CAST(floor(row / 50) AS BIGINT) AS block, row, col, v FROM img), k AS (SELECT block, avg(v) AS m, avg(row) AS mr, avg(col) AS mc, var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc, covar_pop(row, v) AS rv, covar_pop(col, v) AS cv FROM b GROUP BY block), s AS (SELECT *, (rv * cc - cv * rc) / (rr * cc - rc * rc) AS kr, (cv * rr - rv * rc) / (rr * cc - rc * rc) AS kc FROM k) SELECT row, col, round(v - m - kr * (row - mr) - kc * (col - mc), 6) + 0.0 AS v FROM b JOIN s USING (block)")
def a37(spark, sf):
    b = rel.img(spark, sf).withColumn("block", F.floor(c("row") / 50))
    return fit.without_ramp(b, "v", ["block"]).select("row", "col", r6(c("v")).alias("v"))


def _reach(eight: bool) -> str:
    """SQL that labels each cell with the least of the cells it reaches, by a recursion from every cell to later ones."""
    near = "range(-1, 2) i(i), range(-1, 2) j(j)" if eight else "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) n(i, j)"
    return (
        f", f AS (SELECT row, col FROM img WHERE v > 0.1), cc(row, col, label) AS (SELECT row, col, row * 64 + col FROM f UNION SELECT f.row, f.col, cc.label FROM cc, {near}, f "
        "WHERE f.row = cc.row + i AND f.col = cc.col + j AND f.row * 64 + f.col > cc.label), l AS (SELECT row, col, min(label) AS label FROM cc GROUP BY row, col)"
    )


def _large(n: int) -> str:
    return f", k AS (SELECT l.* FROM l JOIN (SELECT label FROM l GROUP BY label HAVING count(*) >= {n}) USING (label))"


def _recursive(body: str) -> str:
    return with_relations("img", body).replace("WITH", "WITH RECURSIVE", 1)


SQL |= {
    "a34_components": _recursive(f"{_reach(True)} SELECT row, col, label FROM l"),
    "a35_size_filter": _recursive(f"{_reach(False)}{_large(6)} SELECT row, col, label FROM k"),
    "j27_closest_pairs": _recursive(
        f"{_reach(True)}{_large(8)}, d AS (SELECT p.label AS a, q.label AS b, p.row AS ar, p.col AS ac, q.row AS br, q.col AS bc, i * i + j * j AS d2 FROM k p, range(-6, 7) i(i), range(-6, 7) j(j), k q WHERE q.row = p.row + i AND q.col = p.col + j AND p.label < q.label AND i * i + j * j <= 36), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY d2, ar, ac, br, bc) AS n FROM d) SELECT a, b, CAST(d2 AS DOUBLE) AS d2, ar, ac, br, bc FROM n WHERE n = 1"
    ),
}


def _labels(spark, sf):
    return components.label(rel.img(spark, sf), c("v") > 0.1, 64)


@query("a34_components")
def a34(spark, sf):
    return _labels(spark, sf)


@query("a35_size_filter")
def a35(spark, sf):
    return components.large_enough(components.label(rel.img(spark, sf), c("v") > 0.1, 64, eight=False), 6)


@query("j27_closest_pairs")
def j27(spark, sf):
    return components.closest_pairs(components.large_enough(_labels(spark, sf), 8), 6)


@query("a36_bridges")
def a36(spark, sf):
    tree = components.bridges(components.large_enough(_labels(spark, sf), 8), 6)
    phase = rel.img(spark, sf).select("row", "col", (c("v") * 40).alias("phase"))
    return components.bridge_turns(tree, phase)


CHIRP = np.exp(1j * math.pi * 0.02 * np.arange(-8, 8) ** 2)


def _lines(spark, sf):
    return lines.to_lines(rel.slc(spark, sf), ["row"])


def _sums(df):
    """A line's energy and its first sample, rounded well above the noise of the transforms."""
    return df.select("row", F.size("re").alias("n"), F.round(F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x), 6).alias("energy"), r6(F.get("re", F.lit(0))).alias("first"))


def _dft(source: str, out: str, n: str = "32") -> str:
    """Transform of the lines of ``source`` (row, col, re, im) to ``n`` frequencies ``k``, as sums of cosines."""
    return f", {out} AS (SELECT row, k, any_value(n) AS n, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im FROM (SELECT row, k, re, im, {n} AS n, 2 * pi() * k * col / {n} AS a FROM {source}, range(0, 256) t(k) WHERE k < {n}) GROUP BY row, k)"


def _back(source: str, out: str, keep: str = "n") -> str:
    """The first ``keep`` samples of the inverse transform."""
    return f", {out} AS (SELECT row, col, sum(re * cos(a) - im * sin(a)) / any_value(n) AS re, sum(im * cos(a) + re * sin(a)) / any_value(n) AS im FROM (SELECT row, col, re, im, n, 2 * pi() * k * col / n AS a FROM {source}, range(0, 256) t(col) WHERE col < {keep}) GROUP BY row, col)"


_FREQ = "(CASE WHEN k < (n + 1) // 2 THEN k ELSE k - n END) / CAST(n AS DOUBLE)"
_TURN = lambda a: f"re * cos({a}) - im * sin({a}) AS re, im * cos({a}) + re * sin({a}) AS im"
_LINE_SUMS = " SELECT row, CAST(count(*) AS INT) AS n, round(sum(re * re + im * im), 6) AS energy, round(arg_min(re, col), 6) + 0.0 AS first FROM o GROUP BY row"
_G1 = (
    ", ch AS (SELECT 0 AS row, j AS col, cos(pi() * 0.02 * pow(7 - j, 2)) AS re, -sin(pi() * 0.02 * pow(7 - j, 2)) AS im FROM range(0, 16) t(j))" + _dft("ch", "h", "64") + _dft("slc", "f", "64") + f", g AS (SELECT f.row, f.k, f.n, f.re * h.re - f.im * h.im AS re, f.im * h.re + f.re * h.im AS im FROM f JOIN (SELECT * FROM h WHERE NOT {_FREQ} BETWEEN 0.24 AND 0.26) h USING (k))" + _back("g", "o", "47")
)
_G2 = _dft("slc", "f") + f", g AS (SELECT * FROM f WHERE abs({_FREQ} - 0.125) <= 0.125)" + _back("g", "b") + f", o AS (SELECT row, col, {_TURN('-2 * pi() * 0.125 * col')} FROM b WHERE col % 2 = 0)"
_G3 = ", tc AS (SELECT row // 256 * 64 + col AS row, row % 256 AS col, re, im FROM slc), tn AS (SELECT *, count(*) OVER (PARTITION BY row) AS m FROM tc)" + _dft("tn", "f", "m") + f", g AS (SELECT * FROM f WHERE abs({_FREQ}) <= 0.3)" + _back("g", "o")
_G4 = _dft("slc", "f") + f", w AS (SELECT *, abs({_FREQ}) AS d FROM f), v AS (SELECT row, k, n, re, im, CASE WHEN d <= 0.15 THEN 1.0 WHEN d <= 0.2 THEN 0.5 * (1 + cos(pi() * (d - 0.15) / (0.2 - 0.15))) ELSE 0.0 END AS w FROM w), g AS (SELECT row, k, n, re * w AS re, im * w AS im FROM v)" + _back("g", "o")
_WIDER = lambda f, g: f", {g} AS (SELECT row, CASE WHEN k < 16 THEN k ELSE k + 32 END AS k, 64 AS n, 2 * re AS re, 2 * im AS im FROM {f})"
_G5 = _dft("slc", "f") + _WIDER("f", "g") + _back("g", "a") + _dft("sec", "f2") + _WIDER("f2", "g2") + _back("g2", "b") + ", o AS (SELECT a.row, a.col // 2 AS col, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im FROM a JOIN b USING (row, col) GROUP BY a.row, a.col // 2)"
_G6 = _dft("slc", "f") + f", g AS (SELECT row, k, n, {_TURN(f'-2 * pi() * {_FREQ} * (row % 7) * 0.25')} FROM f)" + _back("g", "o")


_G11 = _dft("slc", "f") + ", pw AS (SELECT *, log10(re * re + im * im + 1e-30) AS p FROM f), md AS (SELECT row, median(p) AS m FROM pw GROUP BY row), dv AS (SELECT row, any_value(m) AS m, 1.4826 * median(abs(p - m)) + 1e-30 AS sd FROM pw JOIN md USING (row) GROUP BY row), g AS (SELECT pw.* FROM pw JOIN dv USING (row) WHERE (p - m) / sd <= 3.0)" + _back("g", "o")
_G12 = (
    _dft("slc", "f") + ", g AS (SELECT row, CASE WHEN k < 16 THEN k ELSE k + 224 END AS k, 256 AS n, 8 * re AS re, 8 * im AS im FROM f)" + _back("g", "o") + ", q AS (SELECT row, col, re * re + im * im AS q FROM o), b AS (SELECT *, lag(q) OVER w AS b, lead(q) OVER w AS a FROM q WINDOW w AS (PARTITION BY row ORDER BY col)), t AS (SELECT row, arg_max(col, q) AS m, max(q) AS top FROM b GROUP BY row)"
    ", e AS (SELECT row, any_value(m) AS m, any_value(top) AS top, max(CASE WHEN col <= m AND q >= top / 2 AND b < top / 2 THEN col - (q - top / 2) / (q - b) END) AS l, min(CASE WHEN col >= m AND q >= top / 2 AND a < top / 2 THEN col + (q - top / 2) / (q - a) END) AS r, coalesce(max(CASE WHEN col <= m AND b >= q THEN col END), 0) AS i, coalesce(min(CASE WHEN col >= m AND a >= q THEN col END), 255) AS j FROM b JOIN t USING (row) GROUP BY row)"
    ", sl AS (SELECT row, max(q) AS side FROM q JOIN e USING (row) WHERE col < i OR col > j GROUP BY row)"
)
_G7 = (
    ", mv AS (SELECT row + 2 AS row, col - 1 AS col, v FROM img), wn AS (SELECT CAST(floor(a.row / 16) AS BIGINT) AS wy, CAST(floor(a.col / 16) AS BIGINT) AS wx, dy, dx, count(*) AS n, (avg(a.v * b.v) - avg(a.v) * avg(b.v)) / sqrt(var_pop(a.v) * var_pop(b.v)) AS c FROM img a, range(-3, 4) s(dy), range(-3, 4) t(dx), mv b WHERE b.row = a.row + dy AND b.col = a.col + dx GROUP BY 1, 2, 3, 4)"
    ", wh AS (SELECT wy, wx FROM wn WHERE n = 256 GROUP BY wy, wx HAVING count(*) = 49), rk AS (SELECT *, row_number() OVER (PARTITION BY wy, wx ORDER BY c DESC, dy, dx) AS k, sum(c * c) OVER (PARTITION BY wy, wx) AS every FROM wn JOIN wh USING (wy, wx))"
)


@query("g1_range_compression", "slc", f"{_G1}{_LINE_SUMS}")
def g1(spark, sf):
    return _sums(lines.compress(_lines(spark, sf), ["row"], CHIRP, "full", [(0.24, 0.26)]))


@query("g2_split_spectrum", "slc", f"{_G2}{_LINE_SUMS}")
def g2(spark, sf):
    return _sums(lines.band(_lines(spark, sf), ["row"], 0.0, 0.25, step=2))


@query("g3_azimuth_band", "slc", f"{_G3}{_LINE_SUMS}")
def g3(spark, sf):
    turned = rel.slc(spark, sf).select(c("col").alias("line"), (c("row") % 256).alias("col"), F.floor(c("row") / 256).alias("block"), "re", "im")
    columns = lines.to_lines(turned, ["block", "line"])
    return _sums(lines.band(columns, ["block", "line"], -0.3, 0.3, center=False).withColumn("row", c("block") * 64 + c("line")))


_SHARED = (
    ", im2 AS (SELECT 0 AS i, row, col, re, im FROM slc UNION ALL SELECT 1, row, col, re * cos(0.4 * row) - im * sin(0.4 * row), im * cos(0.4 * row) + re * sin(0.4 * row) FROM sec), nx AS (SELECT *, lead(re) OVER w AS nre, lead(im) OVER w AS nim FROM im2 WINDOW w AS (PARTITION BY i, col ORDER BY row))"
    ", dp AS (SELECT i, col, atan2(sum(nim * re - nre * im), sum(nre * re + nim * im)) * 750 / pi() AS f FROM nx GROUP BY i, col), md AS (SELECT col AS line, avg(f) AS mid FROM dp GROUP BY col)"
    ", tc AS (SELECT (CAST(floor(row / 256) AS BIGINT) * 2 + i) * 64 + col AS row, row - CAST(floor(row / 256) AS BIGINT) * 256 AS col, re, im FROM im2), tn AS (SELECT *, count(*) OVER (PARTITION BY row) AS filled, min(col) OVER (PARTITION BY row) AS low FROM tc), tl AS (SELECT row, col - low AS col, re, im, filled AS m FROM tn)"
    + _dft("tl", "f", "m")
    + f", d AS (SELECT f.*, abs({_FREQ} * 1500 - mid) AS d FROM f JOIN md ON md.line = ((f.row % 64) + 64) % 64), g AS (SELECT row, k, n, re * w AS re, im * w AS im FROM (SELECT *, CASE WHEN d <= 300 THEN 1 WHEN d <= 500 THEN 0.5 * (1 + cos(pi() * (d - 300) / 200)) ELSE 0 END AS w FROM d))"
    + _back("g", "o")
)


@query("g3_common_band", "slc sec", f"{_SHARED}{_LINE_SUMS}")
def g3_common(spark, sf):
    """Both images' columns in the band around the mean of their Doppler frequencies, under a raised cosine."""
    turn = F.cos(0.4 * c("row")), F.sin(0.4 * c("row"))
    re, im = cplx.mul(cplx.pair(), turn)
    second = rel.sec(spark, sf).select("row", "col", re.alias("re"), im.alias("im"))
    d = lines.azimuth_common_band(rel.slc(spark, sf), second, 800.0, 1500.0, 0.25, 256)
    return _sums(d.withColumn("row", (c("block") * 2 + c("image")) * 64 + c("line")))


@query("g4_band_pass", "slc", f"{_G4}{_LINE_SUMS}")
def g4(spark, sf):
    return _sums(lines.band(_lines(spark, sf), ["row"], -0.2, 0.2, center=False, taper=0.25))


@query("g5_oversampled_product", "slc sec", f"{_G5}{_LINE_SUMS}")
def g5(spark, sf):
    other = lines.to_lines(rel.sec(spark, sf), ["row"])
    return _sums(lines.cross_multiply(_lines(spark, sf), other, ["row"]))


@query("g6_line_shift", "slc", f"{_G6}{_LINE_SUMS}")
def g6(spark, sf):
    return _sums(lines.shift(_lines(spark, sf).withColumn("by", (c("row") % 7) * 0.25), ["row"], "by"))


@query("g7_offset_tracking", "img", f"{_G7} SELECT wy, wx, dy, dx, round(c * c / ((every - c * c) / 48), 4) AS snr FROM rk WHERE k = 1")
def g7(spark, sf):
    a = rel.img(spark, sf)
    moved = a.select((c("row") + 2).alias("row"), (c("col") - 1).alias("col"), "v")
    return lines.offsets(a, moved, 16, 3).select("wy", "wx", "dy", "dx", F.round("snr", 4).alias("snr"))


@query("g7_subcell_tracking")
def g7_subcell(spark, sf):
    """A smooth image against itself moved by a line and by 5/16 of a cell along lines: correlation sampled finely, with covariance."""
    k = [1.0, 4.0, 6.0, 4.0, 1.0]
    a = neighbours.smooth(rel.img(spark, sf), ["v"], k, k).select("row", "col", "v")
    moved = lines.shift(lines.to_lines(a.select("row", "col", c("v").alias("re"), F.lit(0.0).alias("im")), ["row"]).withColumn("by", F.lit(5 / 16)), ["row"], "by")
    b = lines.to_cells(moved, ["row"]).select((c("row") + 1).alias("row"), "col", c("re").alias("v"))
    d = lines.track(a, b, 16, 4)
    return d.select("wy", "wx", "dy", "dx", *(F.round(x, 5).alias(x) for x in ("snr", "var_y", "var_x", "cov", "peak")))


@query("g10_eigen_interference")
def g10(spark, sf):
    return _sums(lines.remove_loud(_lines(spark, sf), 16, 3, 4.0))


@query("g11_frequency_nulling", "slc", f"{_G11}{_LINE_SUMS}")
def g11(spark, sf):
    return _sums(lines.null_tones(_lines(spark, sf), ["row"], 3.0))


@query("g12_point_target", "slc", f"{_G12} SELECT row, round(m / 8.0, 4) AS peak, round((coalesce(r, 255.0) - coalesce(l, 0.0)) / 8, 4) AS width, round(10 * log10(side / top), 4) AS pslr FROM e LEFT JOIN sl USING (row)")
def g12(spark, sf):
    p = lines.point_target(_lines(spark, sf), ["row"])
    return p.select("row", *(F.round(x, 4).alias(x) for x in ("peak", "width", "pslr")))


@query("g12_target_response")
def g12_response(spark, sf):
    """Chips around targets' strongest cells: place, phase, widths and side lobes along both axes."""
    t = rel.target(spark, sf).select("id", (c("id") % 180 + 20).alias("row"), (c("id") * 7 % 10 + 11).cast("int").alias("col"))
    z = rel.slc(spark, sf)
    peaks = footprint.chip_peaks(t, z, 2, cplx.power(cplx.pair())).select("id", c("prow").alias("row"), c("pcol").alias("col"))
    # Targets with one strongest cell have one chip, named by the least of them.
    first = peaks.groupBy("row", "col").agg(F.min("id").alias("id"))
    d = lines.target_response(footprint.chips(first, z, 8), 8)
    both = peaks.join(first.select("row", "col", c("id").alias("first")), ["row", "col"]).join(d.withColumnRenamed("id", "first"), "first")
    return both.select("id", *(F.round(x, 4).alias(x) for x in d.columns if x != "id"))


@query("g13_wavelength_doppler", "slc", ", p AS (SELECT CAST(floor(col / 4) AS BIGINT) AS bin, row, atan2(im, re) AS p FROM slc), m AS (SELECT bin, avg(p) AS p FROM p GROUP BY bin) SELECT count(*) AS n, round(regr_slope(p, bin), 8) + 0.0 AS slope FROM m")
def g13(spark, sf):
    m = rel.slc(spark, sf).groupBy(F.floor(c("col") / 4).alias("bin")).agg(F.avg(F.atan2("im", "re")).alias("p"))
    return m.agg(F.count("*").alias("n"), (F.round(F.regr_slope("p", "bin"), 8) + F.lit(0.0)).alias("slope"))


_BINS = (
    ", sp AS (SELECT row, k, sum(re * cos(2 * pi() * (k - 16) * col / 32) + im * sin(2 * pi() * (k - 16) * col / 32)) AS re, sum(im * cos(2 * pi() * (k - 16) * col / 32) - re * sin(2 * pi() * (k - 16) * col / 32)) AS im FROM slc, range(0, 32) b(k) GROUP BY row, k)"
    ", ph AS (SELECT a.k, atan2(avg(b.im * a.re - b.re * a.im), avg(b.re * a.re + b.im * a.im)) AS p FROM sp a JOIN sp b ON b.row = a.row + 1 AND b.k = a.k WHERE a.k BETWEEN 4 AND 27 GROUP BY a.k)"
    f", st AS (SELECT k, p, coalesce(-round_even((p - lag(p) OVER (ORDER BY k)) / {2 * math.pi}, 0), 0) AS s FROM ph), un AS (SELECT k, p + {2 * math.pi} * sum(s) OVER (ORDER BY k) AS p FROM st)"
)


@query("g13_spectral_doppler", "slc", f"{_BINS} SELECT count(*) AS bins, round(regr_slope(p, (k - 16) / 32.0), 6) + 0.0 AS slope, round(regr_slope(p, (k - 16) / 32.0) * 1257.5 * 1500 / 48 / (2 * pi()), 3) + 0.0 AS doppler FROM un")
def g13_spectral(spark, sf):
    """Each line's range spectrum, products of neighbouring lines by bin, their phases unwrapped over the band and fitted by a line."""
    spectrum = lines.to_cells(lines.spectra(_lines(spark, sf), ["row"]), ["row"])
    phase = stats.lag_doppler(spectrum, ["col"], 2 * math.pi).select("col", c("doppler").alias("phase"))
    d = stats.spectral_slope(phase, 32, 0.375, 1500.0, 1257.5 / 48)
    return d.select("bins", r6(c("slope")).alias("slope"), (F.round("doppler", 3) + F.lit(0.0)).alias("doppler"))


#: Eigenvalues of the covariance of three lines, by the angles of the cubic's roots.
_THREE = (
    ", tr AS (SELECT CAST(floor(a.row / 3) AS BIGINT) AS k, avg(a.re * a.re + a.im * a.im) AS p, avg(b.re * b.re + b.im * b.im) AS q, avg(d.re * d.re + d.im * d.im) AS s, avg(a.re * b.re + a.im * b.im) AS xr, avg(a.im * b.re - a.re * b.im) AS xi, avg(a.re * d.re + a.im * d.im) AS yr, avg(a.im * d.re - a.re * d.im) AS yi, avg(b.re * d.re + b.im * d.im) AS zr, avg(b.im * d.re - b.re * d.im) AS zi"
    " FROM slc a JOIN slc b ON b.row = a.row + 1 AND b.col = a.col JOIN slc d ON d.row = a.row + 2 AND d.col = a.col WHERE a.row % 3 = 0 GROUP BY 1)"
    ", c0 AS (SELECT *, (p + q + s) / 3 AS m FROM tr), c1 AS (SELECT *, sqrt((pow(p - m, 2) + pow(q - m, 2) + pow(s - m, 2) + 2 * (xr * xr + xi * xi + yr * yr + yi * yi + zr * zr + zi * zi)) / 6) AS h FROM c0)"
    ", c2 AS (SELECT *, ((p - m) * (q - m) * (s - m) + 2 * ((xr * zr - xi * zi) * yr + (xr * zi + xi * zr) * yi) - (p - m) * (zr * zr + zi * zi) - (q - m) * (yr * yr + yi * yi) - (s - m) * (xr * xr + xi * xi)) / (2 * pow(h, 3)) AS r FROM c1)"
    ", ev AS (SELECT k, m + 2 * h * cos(acos(greatest(least(r, 1), -1)) / 3) AS e0, m + 2 * h * cos(acos(greatest(least(r, 1), -1)) / 3 - 2 * pi() / 3) AS e1, m + 2 * h * cos(acos(greatest(least(r, 1), -1)) / 3 + 2 * pi() / 3) AS e2 FROM c2)"
)


def _triples(spark, sf):
    return lines.eigenvalues(_lines(spark, sf), 3).where(F.size("values") == 3)


@query("a18_interval_noise", "slc", f"{_THREE} SELECT count(*) AS intervals, round(median(e2), 6) AS power, round(median((e1 + e2) / 2), 6) AS middle FROM ev")
def a18_intervals(spark, sf):
    """Noise from the least eigenvalues of intervals of three lines, and from the middle of all but the largest."""
    e = materialize(_triples(spark, sf), "eigenvalues")
    a = stats.noise_by_interval(e, 3)
    return a.crossJoin(F.broadcast(stats.noise_by_interval(e, 3, median=True).select(c("power").alias("middle")))).select("intervals", r6(c("power")).alias("power"), r6(c("middle")).alias("middle"))


@query("a28_eigenvalue_slopes", "slc", f"{_THREE}, dbs AS (SELECT k, k // 20 AS block, 10 * log10(abs(e0)) AS d0, 10 * log10(abs(e1)) AS d1, 10 * log10(abs(e2)) AS d2 FROM ev), sl AS (SELECT *, d0 - lag(d0) OVER w AS s0, d1 - lag(d1) OVER w AS s1, d2 - lag(d2) OVER w AS s2 FROM dbs WINDOW w AS (PARTITION BY block ORDER BY k)), sd AS (SELECT block, CASE WHEN stddev_pop(d0) >= stddev_pop(d1) THEN stddev_pop(s0) ELSE stddev_pop(s1) END / nullif(stddev_pop(s2), 0) AS ratio, stddev_pop(s2) AS sd, avg(s2) AS mean FROM sl GROUP BY block), th AS (SELECT block, ratio, mean + (5 - 3 * least(greatest((ratio - 2) / 18, 0), 1)) * sd AS threshold FROM sd) SELECT k, block, round(ratio, 5) AS ratio, round(threshold, 5) AS threshold, CASE WHEN d2 - d1 < -threshold THEN 2 WHEN d1 - d0 < -threshold THEN 1 ELSE 0 END AS loud FROM dbs JOIN th USING (block)")
def a28_slopes(spark, sf):
    """Per block of intervals the threshold on the fall between eigenvalues, and how many of each interval are interference."""
    e = materialize(_triples(spark, sf), "eigenvalues")
    t = materialize(stats.eigenvalue_threshold(e, 20, 2, 2), "thresholds")
    loud = stats.loud_eigenvalues(e, t, 20, 2)
    d = loud.withColumn("block", F.floor(c("k") / 20)).join(t, "block")
    return d.select("k", "block", F.round("ratio", 5).alias("ratio"), F.round("threshold", 5).alias("threshold"), "loud")


_BANK = (
    ", wd AS (SELECT row, col, re, im, 8 * b AS mid, 0.5 - 0.5 * cos(2 * pi() * (col - 8 * b + 8) / 16) AS w, cos(2 * pi() * 0.17 * col) AS u, sin(2 * pi() * 0.17 * col) AS v FROM slc, range(0, 5) t(b) WHERE col >= 8 * b - 8 AND col < 8 * b + 8)"
    ", cf AS (SELECT row, mid, sum(w * (re * u + im * v)) / sum(w) AS cr, sum(w * (im * u - re * v)) / sum(w) AS ci FROM wd GROUP BY row, mid)"
)


@query("w19_tone_bank", "slc", f"{_BANK} SELECT row, col, round(any_value(re) - sum(w * (cr * u - ci * v)), 6) + 0.0 AS re, round(any_value(im) - sum(w * (cr * v + ci * u)), 6) + 0.0 AS im FROM wd JOIN cf USING (row, mid) GROUP BY row, col")
def w19_bank(spark, sf):
    """A tone of varying strength taken off each line by windows that overlap by half."""
    d = lines.to_cells(lines.remove_tone(_lines(spark, sf), ["row"], 0.17, 16), ["row"])
    return d.select("row", "col", r6(c("re")).alias("re"), r6(c("im")).alias("im"))
