"""Cell-wise operators and filters (P, F)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echogrid.functions import cplx, geodesy, radar
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6

c = F.col
PI = math.pi


def _pair(z) -> list:
    return [r6(z[0]).alias("re"), r6(z[1]).alias("im")]


def _two(spark: SparkSession, sf: str) -> DataFrame:
    s = rel.sec(spark, sf).withColumnsRenamed({"re": "bre", "im": "bim"})
    return rel.slc(spark, sf).join(s, ["row", "col"])


@query("p1_complex_algebra", "slc sec", "SELECT row, col, round(a.re * b.re - a.im * b.im, 6) + 0.0 AS mul_re, round(a.re * b.im + a.im * b.re, 6) + 0.0 AS mul_im, round(a.re * b.re + a.im * b.im, 6) + 0.0 AS conj_re, round(a.im * b.re - a.re * b.im, 6) + 0.0 AS conj_im, round(sqrt(a.re * a.re + a.im * a.im), 6) + 0.0 AS mod, round(atan2(a.im, a.re), 6) + 0.0 AS phase FROM slc a JOIN sec b USING (row, col)")
def p1(spark, sf):
    a, b = cplx.pair(), cplx.pair("b")
    m, k = cplx.mul(a, b), cplx.conj_mul(a, b)
    return _two(spark, sf).select("row", "col", r6(m[0]).alias("mul_re"), r6(m[1]).alias("mul_im"), r6(k[0]).alias("conj_re"), r6(k[1]).alias("conj_im"), r6(cplx.modulus(a)).alias("mod"), r6(cplx.phase(a)).alias("phase"))


@query("p2_wrapped_phase", "slc", "SELECT row, col, round(atan2(im, re), 6) + 0.0 AS phase FROM slc")
def p2(spark, sf):
    return rel.slc(spark, sf).select("row", "col", r6(cplx.phase(cplx.pair())).alias("phase"))


@query("p3_flatten", "slc", f", t AS (SELECT *, {-4 * PI * 6.25 / 0.24} * (0.01 * row + 0.001 * col) AS a FROM slc) SELECT row, col, round(re * cos(a) - im * sin(a), 6) + 0.0 AS re, round(re * sin(a) + im * cos(a), 6) + 0.0 AS im FROM t")
def p3(spark, sf):
    return rel.slc(spark, sf).select("row", "col", *_pair(radar.flatten(cplx.pair(), 0.01 * c("row") + 0.001 * c("col"), 6.25, 0.24)))


@query("p4_backscatter", "slc", "SELECT row, col, round(re * re + im * im, 6) + 0.0 AS power FROM slc")
def p4(spark, sf):
    return rel.slc(spark, sf).select("row", "col", r6(cplx.power(cplx.pair())).alias("power"))


@query("p5_decibels", "slc", ", t AS (SELECT row, col, re * re + im * im AS p FROM slc) SELECT row, col, round(CASE WHEN p > 0 THEN 10 * log10(p) END, 6) + 0.0 AS db, round(CASE WHEN p > 0 THEN pow(10.0, 10 * log10(p) / 10) END, 6) + 0.0 AS back FROM t")
def p5(spark, sf):
    d = radar.db(cplx.power(cplx.pair()))
    return rel.slc(spark, sf).select("row", "col", r6(d).alias("db"), r6(radar.undb(d)).alias("back"))


@query("p6_apply_rtc", "slc", ", t AS (SELECT row, col, re * re + im * im AS v, abs(re) * 10 AS rtc FROM slc), u AS (SELECT *, CASE WHEN rtc >= 0.05 AND rtc > 0 AND v <> 0 THEN v * 1.5 / rtc END AS x FROM t) SELECT row, col, round(CASE WHEN x < 0.001 THEN 0.001 WHEN x > 0.5 THEN 0.5 ELSE x END, 6) + 0.0 AS v FROM u")
def p6(spark, sf):
    factors = rel.slc(spark, sf).select("row", "col", (F.abs("re") * 10).alias("rtc"))
    image = rel.slc(spark, sf).select("row", "col", cplx.power(cplx.pair()).alias("v"))
    return image.join(factors, ["row", "col"]).select("row", "col", r6(radar.terrain_corrected(c("v"), c("rtc"), 1.5, 0.05, 0.001, 0.5)).alias("v"))


@query("p7_area_ratio", "slc", ", t AS (SELECT row, col, abs(re) AS a, CASE WHEN col % 7 = 0 THEN 0.0 ELSE abs(im) END AS b FROM slc), u AS (SELECT row, col, a / nullif(b, 0.0) AS x FROM t WHERE b = 0 OR b > 0.0001) SELECT row, col, round(CASE WHEN x >= pow(10.0, -0.3) THEN x END, 4) + 0.0 AS ratio FROM u")
def p7(spark, sf):
    b = F.when(c("col") % 7 == 0, 0.0).otherwise(F.abs("im"))
    return rel.slc(spark, sf).select("row", "col", F.abs("re").alias("a"), b.alias("b")).where("b = 0 OR b > 0.0001").select("row", "col", (F.round(radar.area_ratio(c("a"), c("b"), -3.0), 4) + F.lit(0.0)).alias("ratio"))


@query("p8_denoise", "slc", ", t AS (SELECT *, re * re + im * im AS p, 0.002 + 0.0001 * col AS n FROM slc), u AS (SELECT *, CASE WHEN p > 0 THEN sqrt(greatest(p - n, 0.0) / p) ELSE 0.0 END AS k FROM t) SELECT row, col, round(greatest(p - n, 0.0), 6) + 0.0 AS power, round(re * k, 6) + 0.0 AS re, round(im * k, 6) + 0.0 AS im FROM u")
def p8(spark, sf):
    noise = 0.002 + 0.0001 * c("col")
    return rel.slc(spark, sf).select("row", "col", r6(radar.denoised_power(cplx.power(cplx.pair()), noise)).alias("power"), *_pair(radar.denoised(cplx.pair(), noise)))


@query("p9_mask_digits", "mask", "SELECT row, col, m % 10 > 0 AS secondary, floor(m / 10) % 10 > 0 AS reference, floor(m / 100) % 10 > 0 AS water FROM mask")
def p9(spark, sf):
    return rel.mask(spark, sf).select("row", "col", *(x.alias(k) for k, x in radar.mask_digits(c("m")).items()))


@query("p10_water_binary", "img", ", t AS (SELECT row, col, CAST(floor(abs(v) * 1000) AS INT) % 256 AS d FROM img) SELECT row, col, CASE WHEN d = 255 THEN 255 WHEN d BETWEEN 1 AND 200 THEN 1 ELSE 0 END AS water FROM t")
def p10(spark, sf):
    d = F.floor(F.abs("v") * 1000).cast("int") % 256
    return rel.img(spark, sf).select("row", "col", radar.water_binary(d).alias("water"))


@query("p11_mask_composition", "mask", "SELECT row, col, m % 100 + 100 * CAST(row % 3 = 0 AS INT) AS with_water, ((m & CAST(4278190079 AS BIGINT)) | (CAST(col % 2 AS BIGINT) << 24)) AS with_flag FROM mask")
def p11(spark, sf):
    m = rel.mask(spark, sf)
    water = m.select("row", "col", (c("row") % 3 == 0).cast("int").alias("w"))
    return m.join(water, ["row", "col"]).select("row", "col", radar.with_water(c("m") % 100, c("w")).alias("with_water"), radar.with_bit24(c("m").cast("long"), (c("col") % 2).cast("long")).alias("with_flag"))


F0, FL, FH, F1 = 1257.5, 1237.5, 1277.5, 1293.5
_BANDS = ", t AS (SELECT row, col, re * 40 AS a, im * 40 AS b, 0.2 + 0.7 * abs(re) AS g, 0.2 + 0.7 * abs(im) AS h FROM slc)"


def _bands(spark, sf):
    return rel.slc(spark, sf).select("row", "col", (c("re") * 40).alias("a"), (c("im") * 40).alias("b"), (0.2 + 0.7 * F.abs("re")).alias("g"), (0.2 + 0.7 * F.abs("im")).alias("h"))


def _phases(z) -> list:
    return [r6(z[0]).alias("dispersive"), r6(z[1]).alias("nondispersive")]


@query("p12_iono_low_high", "slc", f"{_BANDS} SELECT row, col, round(({FH} * a - {FL} * b) * {FL * FH / F0 / (FH**2 - FL**2)}, 6) + 0.0 AS dispersive, round(({FH} * b - {FL} * a) * {F0 / (FH**2 - FL**2)}, 6) + 0.0 AS nondispersive FROM t")
def p12(spark, sf):
    return _bands(spark, sf).select("row", "col", *_phases(radar.iono_low_high(F0, FL, FH, c("a"), c("b"))))


@query("p13_iono_main_diff", "slc", f"{_BANDS} SELECT row, col, round({FL * FH / F0 / (FL + FH)} * a - {FL * FH / F0 / (FH - FL) / 2} * b, 6) + 0.0 AS dispersive, round(a / 2 - {FL * FH / F0 / (FH - FL) / 2} * b, 6) + 0.0 AS nondispersive FROM t")
def p13(spark, sf):
    return _bands(spark, sf).select("row", "col", *_phases(radar.iono_main_diff(F0, FL, FH, c("a"), c("b"))))


@query("p14_iono_main_side", "slc", f"{_BANDS} SELECT row, col, round((b - a * {F1 / F0}) / {F0 / F1 - F1 / F0}, 6) + 0.0 AS dispersive, round((a * {F0 / F1} - b) / {F0 / F1 - F1 / F0}, 6) + 0.0 AS nondispersive FROM t")
def p14(spark, sf):
    return _bands(spark, sf).select("row", "col", *_phases(radar.iono_main_side(F0, F1, c("a"), c("b"))))


@query("p15_iono_main_diff_side", "slc", f"{_BANDS} SELECT row, col, round(((a - b) - a * {F1 / F0}) / {F0 / F1 - F1 / F0}, 6) + 0.0 AS dispersive, round((a * {F0 / F1} - (a - b)) / {F0 / F1 - F1 / F0}, 6) + 0.0 AS nondispersive FROM t")
def p15(spark, sf):
    return _bands(spark, sf).select("row", "col", *_phases(radar.iono_main_diff_side(F0, F1, c("a"), c("b"))))


@query("p16_phase_sigma", "slc", f"{_BANDS} SELECT row, col, round(sqrt(1 - g * g) / g / {math.sqrt(2 * 20)}, 6) + 0.0 AS sigma FROM t")
def p16(spark, sf):
    return _bands(spark, sf).select("row", "col", r6(radar.phase_sigma(c("g"), 20)).alias("sigma"))


@query("p17_iono_sigma", "slc", f"{_BANDS} SELECT row, col, round({FL * FH / F0 / (FH**2 - FL**2)} * sqrt({FH**2} * g * g + {FL**2} * h * h), 6) + 0.0 AS split_disp, round({F0 / (FH**2 - FL**2)} * sqrt({FL**2} * g * g + {FH**2} * h * h), 6) + 0.0 AS split_non, round(sqrt({(FL * FH / F0 / (FH + FL)) ** 2} * g * g + {(FL * FH / F0 / 2 / (FH - FL)) ** 2} * h * h), 6) + 0.0 AS diff_disp, round(sqrt(g * g / 4 + {(FL * FH / F0 / 2 / (FH - FL)) ** 2} * h * h), 6) + 0.0 AS diff_non, round(sqrt(pow({F1 * F1} * g, 2) + pow({F0 * F1} * h, 2)) / {F1**2 - F0**2}, 6) + 0.0 AS side_disp, round({F0 / (F1**2 - F0**2)} * sqrt(pow({F0} * g, 2) + pow({F1} * h, 2)), 6) + 0.0 AS side_non FROM t")
def p17(spark, sf):
    g, h = c("g"), c("h")
    parts = {"split": radar.sigma_low_high(F0, FL, FH, g, h), "diff": radar.sigma_main_diff(F0, FL, FH, g, h), "side": radar.sigma_main_side(F0, F1, g, h)}
    return _bands(spark, sf).select("row", "col", *(r6(x).alias(f"{k}_{n}") for k, z in parts.items() for n, x in zip(("disp", "non"), z, strict=True)))


_T = 2 * PI


@query(
    "p18_unwrap_turns",
    "slc",
    f""", t AS (SELECT row, col, re * 90 AS a, im * 90 AS b, re * 9 AS d, im * 9 AS n FROM slc),
u AS (SELECT *, round_even((b - a - n * {(FH - FL) / F0} + d * {F0 * (FH - FL) / (FH * FL)}) / {_T}, 0) AS k1, round_even((n * {1 - F1 / F0} + d * {1 - F0 / F1} + b - a) / {_T}, 0) AS k4 FROM t)
SELECT row, col, round_even((a + b - 2 * n - 2 * d) / {2 * _T} - k1 / 2, 0) + 0.0 AS split_common, k1 + 0.0 AS split_diff,
round_even((a - n - d) / {_T}, 0) + 0.0 AS diff_common, round_even((b - n * {(FH - FL) / F0} - d * {F0 * (1 / FH - 1 / FL)}) / {_T}, 0) + 0.0 AS diff_diff,
round_even((a - n - d) / {_T}, 0) + 0.0 AS ms_common, round_even((b + n * {(F1 - F0) / F0} - d * {(F1 - F0) / F1}) / {_T}, 0) + 0.0 AS ms_diff,
round_even((a + b - n * {1 + F1 / F0} - d * {1 + F0 / F1} - {_T} * k4) / {2 * _T}, 0) + 0.0 AS side_common, k4 + 0.0 AS side_diff FROM u""",
)
def p18(spark, sf):
    t = rel.slc(spark, sf).select("row", "col", (c("re") * 90).alias("a"), (c("im") * 90).alias("b"), (c("re") * 9).alias("d"), (c("im") * 9).alias("n"))
    a, b, d, n = (c(x) for x in "abdn")
    parts = {"split": radar.turns_low_high(F0, FL, FH, d, n, a, b), "diff": radar.turns_main_diff(F0, FL, FH, d, n, a, b), "ms": radar.turns_main_diff_side(F0, F1, d, n, a, b), "side": radar.turns_main_side(F0, F1, d, n, a, b)}
    return t.select("row", "col", *((x + F.lit(0.0)).alias(f"{k}_{m}") for k, z in parts.items() for m, x in zip(("common", "diff"), z, strict=True)))


@query("p19_enu_basis", "target", "SELECT id, round(-sin(radians(lon)), 6) + 0.0 AS ex, round(cos(radians(lon)), 6) + 0.0 AS ey, round(-sin(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS nx, round(-sin(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS ny, round(cos(radians(lat)), 6) + 0.0 AS nz, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS ux, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS uy, round(sin(radians(lat)), 6) + 0.0 AS uz FROM target")
def p19(spark, sf):
    e, n, u = geodesy.enu(F.radians("lon"), F.radians("lat"))
    return rel.target(spark, sf).select("id", r6(e[0]).alias("ex"), r6(e[1]).alias("ey"), *(r6(x).alias(f"n{k}") for k, x in zip("xyz", n, strict=True)), *(r6(x).alias(f"u{k}") for k, x in zip("xyz", u, strict=True)))


_A, _E2 = geodesy.A, geodesy.E2
_XYZ = f", g AS (SELECT *, radians(lon) AS lo, radians(lat) AS la, {_A} / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)) AS rn FROM target), e AS (SELECT *, (rn + h) * cos(la) * cos(lo) AS x, (rn + h) * cos(la) * sin(lo) AS y, (rn * {1 - _E2} + h) * sin(la) AS z FROM g)"


@query("p20_geodetic_ecef", "target", f"{_XYZ} SELECT id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, round(lon, 6) + 0.0 AS lon_back, round(lat, 6) + 0.0 AS lat_back, round(h, 3) + 0.0 AS h_back FROM e")
def p20(spark, sf):
    x, y, z = geodesy.to_xyz(F.radians("lon"), F.radians("lat"), c("h"))
    t = rel.target(spark, sf).select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat, h = geodesy.to_llh(c("x"), c("y"), c("z"))
    return t.select("id", *((F.round(k, 3) + F.lit(0.0)).alias(k) for k in "xyz"), r6(F.degrees(lon)).alias("lon_back"), r6(F.degrees(lat)).alias("lat_back"), (F.round(h, 3) + F.lit(0.0)).alias("h_back"))


@query("p21_radii_normal", "target", f"SELECT id, round({_A} / sqrt(1 - {_E2} * pow(sin(radians(lat)), 2)), 3) AS east, round({_A * (1 - _E2)} / pow(1 - {_E2} * pow(sin(radians(lat)), 2), 1.5), 3) AS north, round(cos(radians(lat)) * cos(radians(lon)), 6) + 0.0 AS nx, round(cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS ny, round(sin(radians(lat)), 6) + 0.0 AS nz FROM target")
def p21(spark, sf):
    lon, lat = F.radians("lon"), F.radians("lat")
    up = geodesy.enu(lon, lat)[2]
    return rel.target(spark, sf).select("id", F.round(geodesy.r_east(lat), 3).alias("east"), F.round(geodesy.r_north(lat), 3).alias("north"), *(r6(x).alias(k) for k, x in zip(("nx", "ny", "nz"), up, strict=True)))


@query("p22_projections", "target", f"SELECT id, round(lon, 6) + 0.0 AS utm_lon, round(lat, 6) + 0.0 AS utm_lat, round({_A} * cos(radians(30.0)) / sqrt(1 - {_E2} * pow(sin(radians(30.0)), 2)) * radians(lon), 3) + 0.0 AS cea_x, round(lon, 6) + 0.0 AS cea_lon, round(lat, 6) + 0.0 AS cea_lat, round(lon, 6) + 0.0 AS polar_lon, round(lat, 6) + 0.0 AS polar_lat FROM target WHERE lat BETWEEN -79 AND 83")
def p22(spark, sf):
    t = rel.target(spark, sf).where("lat BETWEEN -79 AND 83")
    lon, lat = F.radians("lon"), F.radians("lat")
    north, zone = c("lat") >= 0, geodesy.utm_zone(c("lon"))
    ux, uy = geodesy.utm(lon, lat, zone, north)
    cx, cy = geodesy.equal_area(lon, lat)
    px, py = geodesy.polar(lon, lat, north)
    p = t.select("id", zone.alias("zone"), north.alias("north"), ux.alias("ux"), uy.alias("uy"), cx.alias("cx"), cy.alias("cy"), px.alias("px"), py.alias("py"))
    out = {"utm": geodesy.utm_inverse(c("ux"), c("uy"), c("zone"), c("north")), "cea": geodesy.equal_area_inverse(c("cx"), c("cy")), "polar": geodesy.polar_inverse(c("px"), c("py"), c("north"))}
    return p.select("id", (F.round("cx", 3) + F.lit(0.0)).alias("cea_x"), *(r6(F.degrees(v)).alias(f"{k}_{n}") for k, z in out.items() for n, v in zip(("lon", "lat"), z, strict=True)))


@query("p23_epsg_choice", "target", "SELECT id, CAST(CASE WHEN lat >= 75 THEN 3413 WHEN lat <= -75 THEN 3031 WHEN lat > 0 THEN 32601 + floor((lon + 180) / 6) WHEN lat < 0 THEN 32701 + floor((lon + 180) / 6) ELSE 4326 END AS INT) AS epsg FROM target")
def p23(spark, sf):
    return rel.target(spark, sf).select("id", geodesy.epsg(c("lon"), c("lat")).alias("epsg"))


@query("p24_wrap_longitude", "target", "SELECT id, round((lon * 3 + 180) - 360 * floor((lon * 3 + 180) / 360) - 180, 6) + 0.0 AS lon FROM target")
def p24(spark, sf):
    return rel.target(spark, sf).select("id", r6(radar.wrap_degrees(c("lon") * 3)).alias("lon"))


@query("p27_axis_arithmetic", "slc", "SELECT DISTINCT row, round(row / 1500.0 + 10, 6) AS t, round((row / 1500.0 + 10 - 10) * 1500.0, 6) + 0.0 AS line, CAST(800000.0 + 6.25 * (row % 100) AS DOUBLE) AS r, round(6.25 * (row % 100) / 6.25, 6) + 0.0 AS sample, round(800000.0 + 6.25 * (4 - 1) / 2, 6) AS looked_r0 FROM slc")
def p27(spark, sf):
    grids = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"))
    t, r = c("row") / 1500.0 + 10, radar.range_of((c("row") % 100).cast("double"), 800000.0, 6.25)
    return grids.select("row", F.round(t, 6).alias("t"), r6(radar.line_of(t, 10.0, 1500.0)).alias("line"), F.round(r, 6).alias("r"), r6(radar.sample_of(r, 800000.0, 6.25)).alias("sample"), F.round(radar.looked_start(F.lit(800000.0), F.lit(6.25), F.lit(4)), 6).alias("looked_r0"))


@query("p28_snap", "pulse", "SELECT i, ceil(x / 2.5) * 2.5 AS up, floor(x / 2.5) * 2.5 AS down, round_even(x / 2.5, 0) * 2.5 AS near FROM pulse")
def p28(spark, sf):
    return rel.pulse(spark, sf).select("i", radar.snap_up(c("x"), 2.5).alias("up"), radar.snap_down(c("x"), 2.5).alias("down"), radar.snap_near(c("x"), 2.5).alias("near"))


@query("p29_trihedral_rcs", "target", ", l AS (SELECT id, side, abs(cos(radians(lat)) * cos(radians(lon))) AS a, abs(cos(radians(lat)) * sin(radians(lon))) AS b, abs(sin(radians(lat))) AS c FROM target), s AS (SELECT *, list_sort([a, b, c]) AS p, a + b + c AS t FROM l), m AS (SELECT *, CASE WHEN p[1] + p[2] > p[3] THEN t - 2 / t ELSE 4 * p[1] * p[2] / t END AS tri, CASE WHEN p[2] >= p[3] / 2 THEN p[1] * (4 - p[3] / p[2]) ELSE 4 * p[1] * p[2] / p[3] END AS sq FROM s) SELECT id, round(4 * pi() * pow(side, 4) / pow(0.24, 2) * tri * tri, 3) + 0.0 AS triangular, round(4 * pi() * pow(side, 4) / pow(0.24, 2) * sq * sq, 3) + 0.0 AS square FROM m")
def p29(spark, sf):
    u = geodesy.enu(F.radians("lon"), F.radians("lat"))[2]
    return rel.target(spark, sf).select("id", (F.round(radar.trihedral_rcs(*u, c("side"), 0.24), 3) + F.lit(0.0)).alias("triangular"), (F.round(radar.trihedral_rcs(*u, c("side"), 0.24, square=True), 3) + F.lit(0.0)).alias("square"))


@query("p31_effective_looks", "channel", "SELECT id, round(20 * 6.25 * 10 * 4.0 / ((299792458.0 / 2 / (width * 1000000)) * 7.0), 6) AS looks FROM channel")
def p31(spark, sf):
    return rel.channel(spark, sf).select("id", F.round(geodesy.effective_looks(20, 10, F.lit(6.25), F.lit(4.0), c("width") * 1e6, F.lit(7.0)), 6).alias("looks"))


@query("p33_polynomials", "tie", ", t AS (SELECT id, (line - 1003.3) / 997.1 AS u, (pixel - 50.3) / 49.7 AS v FROM tie) SELECT id, round(0.5123 + 0.2517 * u - 0.1253 * u * u, 6) + 0.0 AS one, round(0.5 + 0.25 * v + (0.1 - 0.2 * v) * u + (0.05 + 0.01 * v) * u * u, 6) + 0.0 AS two FROM t")
def p33(spark, sf):
    u, v = (c("line") - 1003.3) / 997.1, (c("pixel") - 50.3) / 49.7
    return rel.tie(spark, sf).select("id", r6(geodesy.poly1(u, [0.5123, 0.2517, -0.1253])).alias("one"), r6(geodesy.poly2(u, v, [[0.5, 0.25], [0.1, -0.2], [0.05, 0.01]])).alias("two"))


@query("p34_tec_delay", "pulse", ", t AS (SELECT i, x AS total, x * 0.3 AS top, radians(30 + (i % 20)) AS a FROM pulse) SELECT i, round(total - top, 6) + 0.0 AS suborbital, round(40.31 * (total - top) * 1e16 / pow(1257500000.0, 2) / cos(a), 6) + 0.0 AS delay FROM t")
def p34(spark, sf):
    sub = c("x") - c("x") * 0.3
    return rel.pulse(spark, sf).select("i", r6(sub).alias("suborbital"), r6(radar.tec_delay(sub, 1257500000.0, F.radians((30 + c("i") % 20).cast("double")))).alias("delay"))


@query("p36_incidence", "target", ", t AS (SELECT id, 7100000.0 AS p, 6371000.0 + h AS g, 800000.0 + 1000 * side AS s FROM target) SELECT id, round(acos((p * p - g * g - s * s) / (2 * g * s)), 6) AS incidence, round(acos((p * p + s * s - g * g) / (2 * p * s)), 6) AS look FROM t")
def p36(spark, sf):
    p, g, s = F.lit(7100000.0), 6371000.0 + c("h"), 800000.0 + 1000 * c("side")
    return rel.target(spark, sf).select("id", F.round(radar.incidence(p, g, s), 6).alias("incidence"), F.round(radar.look_angle(p, g, s), 6).alias("look"))


@query("p38_calibration_layers", "target", ", t AS (SELECT id, radians(20 + id % 30) AS a FROM target) SELECT id, 1.2247448713915890 AS b_beta0, round(sqrt(1 / sin(a)) * sqrt(1.5), 6) AS b_sigma0, round(sqrt(1 / tan(a)) * sqrt(1.5), 6) AS b_gamma0, round(sqrt(sin(a)) * sqrt(1.5), 6) AS s_beta0, round(sqrt(cos(a)) * sqrt(1.5), 6) AS s_gamma0, round(sqrt(tan(a)) * sqrt(1.5), 6) AS g_beta0, round(sqrt(1 / cos(a)) * sqrt(1.5), 6) AS g_sigma0 FROM t".replace("1.2247448713915890", "round(sqrt(1.5), 6)"))
def p38(spark, sf):
    a = F.radians((20 + c("id") % 30).cast("double"))
    layers = {k: radar.calibration(a, 1.5, k) for k in ("beta0", "sigma0", "gamma0")}
    out = [r6(x).alias(f"{k[0]}_{n}") for k, by in layers.items() for n, x in by.items() if n != k or k == "beta0"]
    return rel.target(spark, sf).select("id", *out)


@query("p39_truncate_mantissa", "img", ", t AS (SELECT row, col, v, pow(2.0, floor(log2(abs(v))) - 8) AS k FROM img WHERE v <> 0) SELECT row, col, sign(v) * floor(abs(v) / k) * k AS v FROM t UNION ALL SELECT row, col, 0.0 FROM img WHERE v = 0")
def p39(spark, sf):
    return rel.img(spark, sf).select("row", "col", radar.truncated(c("v"), 8).alias("v"))


@query("p40_range_scaling", "slc", "SELECT row, col, round(re * (800000.0 + 6.25 * col) / 800100.0, 6) + 0.0 AS re, round(im * (800000.0 + 6.25 * col) / 800100.0, 6) + 0.0 AS im FROM slc")
def p40(spark, sf):
    return rel.slc(spark, sf).select("row", "col", *_pair(cplx.scale(cplx.pair(), radar.range_of(c("col"), 800000.0, 6.25) / 800100.0)))


@query("p41_deramp", "slc", ", t AS (SELECT *, 0.3 * col + 0.002 * row * col AS a FROM slc) SELECT row, col, round(re * cos(-a) - im * sin(-a), 6) + 0.0 AS re, round(re * sin(-a) + im * cos(-a), 6) + 0.0 AS im, round(re, 6) + 0.0 AS back_re, round(im, 6) + 0.0 AS back_im FROM t")
def p41(spark, sf):
    a = 0.3 * c("col") + 0.002 * c("row") * c("col")
    down = cplx.rotate(cplx.pair(), -a)
    back = cplx.rotate(down, a)
    return rel.slc(spark, sf).select("row", "col", *_pair(down), r6(back[0]).alias("back_re"), r6(back[1]).alias("back_im"))


@query("p42_demodulate", "slc", f", t AS (SELECT *, {-2 * PI * 3e6 / 24e6} * col AS a FROM slc) SELECT row, col, round(re * cos(a) - im * sin(a), 6) + 0.0 AS re, round(re * sin(a) + im * cos(a), 6) + 0.0 AS im FROM t")
def p42(spark, sf):
    return rel.slc(spark, sf).select("row", "col", *_pair(cplx.rotate(cplx.pair(), c("col") * (-2 * PI * 3e6 / 24e6))))


@query("p43_troposphere_phase", "img", f", a AS (SELECT row, col, v AS wet, v * 2 AS dry FROM img), b AS (SELECT row - 1 AS row, col, v AS wet, v * 2 AS dry FROM img) SELECT row, col, round(-(a.wet - b.wet) * {4 * PI / 0.24}, 5) + 0.0 AS wet, round(-(a.dry - b.dry) * {4 * PI / 0.24}, 5) + 0.0 AS dry, round(-(a.wet + a.dry - b.wet - b.dry) * {4 * PI / 0.24} / cos(radians(35.0)), 5) + 0.0 AS total FROM a JOIN b USING (row, col)")
def p43(spark, sf):
    a = rel.img(spark, sf).select("row", "col", c("v").alias("wet"), (c("v") * 2).alias("dry"))
    b = a.select((c("row") - 1).alias("row"), "col", c("wet").alias("wet2"), c("dry").alias("dry2"))
    k = 4 * PI / 0.24
    wet, dry = -(c("wet") - c("wet2")) * k, -(c("dry") - c("dry2")) * k
    r5 = lambda x: F.round(x, 5) + F.lit(0.0)
    return a.join(b, ["row", "col"]).select("row", "col", r5(wet).alias("wet"), r5(dry).alias("dry"), r5((wet + dry) / math.cos(math.radians(35.0))).alias("total"))


@query("f1_validity_flags", "survey", "SELECT event_id, id, validity FROM survey WHERE validity & 12 <> 0")
def f1(spark, sf):
    return rel.survey(spark, sf).where(c("validity").bitwiseAND(12) != 0).select("event_id", "id", "validity")


@query("f2_heading_tolerance", "survey", ", t AS (SELECT event_id, az / 10 - 1.3 + pi() AS d FROM survey) SELECT event_id FROM t WHERE abs(d - 2 * pi() * floor(d / (2 * pi())) - pi()) <= 0.4")
def f2(spark, sf):
    return rel.survey(spark, sf).where(F.abs(radar.wrapped(c("az") / 10 - 1.3)) <= 0.4).select("event_id")


@query("f3_coherence_mask", "slc", "SELECT row, col FROM slc WHERE abs(re) >= 0.1")
def f3(spark, sf):
    return rel.slc(spark, sf).where(F.abs("re") >= 0.1).select("row", "col")


@query("f4_component_mask", "mask", "SELECT row, col, m % 10 AS label FROM mask WHERE m % 10 > 0")
def f4(spark, sf):
    return rel.mask(spark, sf).where(c("m") % 10 > 0).select("row", "col", (c("m") % 10).alias("label"))


@query("f5_valid_area", "slc mask", "SELECT row, col FROM slc JOIN mask USING (row, col) WHERE abs(re) >= 0.05 AND m % 10 > 0 AND m < 100 AND floor(m / 10) % 10 > 0")
def f5(spark, sf):
    d = radar.mask_digits(c("m"))
    return rel.slc(spark, sf).join(rel.mask(spark, sf), ["row", "col"]).where((F.abs("re") >= 0.05) & d["secondary"] & ~d["water"] & d["reference"]).select("row", "col")


@query("f6_grid_contains", "pulse", "SELECT i FROM pulse WHERE t BETWEEN 1704067200.0 + 3600 AND 1704067200.0 + 864000 AND x BETWEEN 5 AND 50")
def f6(spark, sf):
    return rel.pulse(spark, sf).where(c("t").between(1704067200.0 + 3600, 1704067200.0 + 864000) & c("x").between(5, 50)).select("i")


@query("f7_crop", "img", "SELECT row - 10 AS row, col - 5 AS col, round(v, 6) + 0.0 AS v FROM img WHERE row >= 10 AND row < 110 AND col >= 5 AND col < 45")
def f7(spark, sf):
    return rel.img(spark, sf).where("row >= 10 AND row < 110 AND col >= 5 AND col < 45").select((c("row") - 10).alias("row"), (c("col") - 5).alias("col"), r6(c("v")).alias("v"))


@query("f8_crop_series", "", "WITH s AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT user_id, min(n) AS lo, max(n) AS hi FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY user_id) SELECT event_id, s.user_id FROM s JOIN b USING (user_id) WHERE n BETWEEN lo - 2 AND hi + 2")
def f8(spark, sf):
    e = rel.read(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = e.withColumn("n", F.row_number().over(w))
    inside = c("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    both = Window.partitionBy("user_id")
    near = numbered.withColumns({"lo": F.min(F.when(inside, c("n"))).over(both), "hi": F.max(F.when(inside, c("n"))).over(both)})
    return near.where(c("n").between(c("lo") - 2, c("hi") + 2)).select("event_id", "user_id")


@query("f9_slant_range_valid", "img", ", t AS (SELECT row, col, CASE WHEN col % 9 = 0 THEN NULL ELSE 800000 + v * 1000 END AS r FROM img) SELECT row, col, round(r, 3) AS r FROM t WHERE r BETWEEN 799900 AND 800100")
def f9(spark, sf):
    r = F.when(c("col") % 9 != 0, 800000 + c("v") * 1000)
    return rel.img(spark, sf).select("row", "col", r.alias("r")).where(c("r").between(799900, 800100)).select("row", "col", F.round("r", 3).alias("r"))


@query("f10_offset_culling", "tie", "SELECT id, CASE WHEN corr >= 0.3 AND dp <= 0.06 THEN dl END AS dl, CASE WHEN corr >= 0.3 AND dp <= 0.06 THEN dp END AS dp FROM tie")
def f10(spark, sf):
    ok = (c("corr") >= 0.3) & (c("dp") <= 0.06)
    return rel.tie(spark, sf).select("id", F.when(ok, c("dl")).alias("dl"), F.when(ok, c("dp")).alias("dp"))


@query("f11_noise_pulses", "", "WITH t AS (SELECT event_id, CAST(floor(event_id / 500) AS BIGINT) AS block, event_type, row_number() OVER (PARTITION BY floor(event_id / 500) ORDER BY event_id) AS n FROM events WHERE event_type = 'error') SELECT event_id, block FROM t WHERE n <= 20")
def f11(spark, sf):
    e = rel.read(spark, sf, "events").where("event_type = 'error'").withColumn("block", F.floor(c("event_id") / 500))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("event_id"))).where("n <= 20").select("event_id", "block")


@query("f12_decimate", "img", "SELECT CAST(floor((row - 1) / 3) AS BIGINT) AS row, CAST(floor((col - 2) / 4) AS BIGINT) AS col, round(v, 6) + 0.0 AS v FROM img WHERE row >= 1 AND col >= 2 AND (row - 1) % 3 = 0 AND (col - 2) % 4 = 0")
def f12(spark, sf):
    kept = rel.img(spark, sf).where((c("row") >= 1) & (c("col") >= 2) & ((c("row") - 1) % 3 == 0) & ((c("col") - 2) % 4 == 0))
    return kept.select(F.floor((c("row") - 1) / 3).alias("row"), F.floor((c("col") - 2) / 4).alias("col"), r6(c("v")).alias("v"))
