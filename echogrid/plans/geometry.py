"""Radar geometry over targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from echogrid.functions import geodesy
from echogrid.operators import geometry
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6

c = F.col
#: A platform that passes over each target's scene on a straight line.
V = (0.0, 7500.0, 0.0)
_T = ", g AS (SELECT id, id % 16 AS orbit_id, 6371000.0 + (id % 40) * 1000.0 AS x, 20000.0 + (id * 7919 % 500) * 1000.0 AS y, ((id * 31) % 200) * 1000.0 - 100000.0 AS z FROM target), o AS (SELECT *, 7071000.0 + orbit_id * 10.0 AS px, 0.0 AS py, -300000.0 - orbit_id * 500.0 AS pz FROM g)"


def _scene(spark, sf):
    k = c("id")
    return rel.target(spark, sf).select("id", (k % 16).alias("orbit_id"), (6371000.0 + (k % 40) * 1000.0).alias("x"), (20000.0 + (k * 7919 % 500) * 1000.0).alias("y"), (((k * 31) % 200) * 1000.0 - 100000.0).alias("z"))


def _orbit(spark, targets):
    ids = targets.select("orbit_id").distinct()
    return geometry.straight_orbits(spark, ids, 10, 10.0, (7071000.0 + c("orbit_id") * 10.0, F.lit(0.0), -300000.0 - c("orbit_id") * 500.0), V)


@query("j15_ground_to_radar", "target", f"{_T} SELECT id, round(y / 7500.0, 5) AS t, round(sqrt(pow(x - px, 2) + pow(z - pz, 2)), 3) AS r FROM o")
def j15(spark, sf):
    t = _scene(spark, sf)
    return geometry.ground_to_radar(t, _orbit(spark, t)).select("id", F.round("t", 5).alias("t"), F.round("r", 3).alias("r"))


_L = ", l AS (SELECT id, x - px AS lx, y - 30000.0 AS ly, z - pz AS lz FROM o)"


def _looks(spark, sf):
    k = c("orbit_id")
    return _scene(spark, sf).withColumns({"px": 7071000.0 + k * 10.0, "py": F.lit(30000.0), "pz": -300000.0 - k * 500.0, "vx": F.lit(V[0]), "vy": F.lit(V[1]), "vz": F.lit(V[2])})



def _vector(kind=""):
    return c(f"{kind}x"), c(f"{kind}y"), c(f"{kind}z")


@query("p25_line_of_sight_doppler", "target", f"{_T}{_L} SELECT id, round(2 / 0.24 * 7500.0 * ly / sqrt(lx * lx + ly * ly + lz * lz), 4) + 0.0 AS doppler FROM l")
def p25(spark, sf):
    return _looks(spark, sf).select("id", (F.round(geometry.doppler(geodesy.minus(_vector(), _vector("p")), _vector("v"), 0.24), 4) + F.lit(0.0)).alias("doppler"))


@query("p26_bistatic_delay", "target", f"{_T}{_L} SELECT id, round(1e6 * 2 * (299792458.0 * sqrt(lx * lx + ly * ly + lz * lz) - ly * 7500.0) / (pow(299792458.0, 2) - 7500.0 * 7500.0), 5) AS micros FROM l")
def p26(spark, sf):
    return _looks(spark, sf).select("id", F.round(1e6 * geometry.bistatic_delay(_vector("p"), _vector("v"), _vector()), 5).alias("micros"))


@query("p35_baselines", "target", f"{_T}{_L}, b AS (SELECT *, 120.0 + id % 9 AS bx, -80.0 + id % 5 AS bz, sqrt(lx * lx + ly * ly + lz * lz) AS n FROM l), k AS (SELECT *, (bx * lx + bz * lz) / n AS par, bx * (-lz) + bz * lx AS side FROM b) SELECT id, round(par, 4) + 0.0 AS parallel, round(sqrt(bx * bx + bz * bz - par * par) * CASE WHEN side < 0 THEN -1.0 ELSE 1.0 END, 4) + 0.0 AS perpendicular FROM k")
def p35(spark, sf):
    second = (c("px") + 120.0 + c("id") % 9, c("py") + 55.0, c("pz") - 80.0 + c("id") % 5)
    par, perp = geometry.baselines(_vector("p"), _vector("v"), second, _vector())
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    return _looks(spark, sf).select("id", r4(par).alias("parallel"), r4(perp).alias("perpendicular"))


_BASIS = ", e AS (SELECT id, h, radians(lon) AS lo, radians(lat) AS la FROM target), b AS (SELECT id, h, -sin(lo) AS ex, cos(lo) AS ey, -sin(la) * cos(lo) AS nx, -sin(la) * sin(lo) AS ny, cos(la) AS nz, cos(la) * cos(lo) AS ux, cos(la) * sin(lo) AS uy, sin(la) AS uz FROM e)"


@query("p37_velocity_components", "target", f"{_BASIS}, v AS (SELECT *, 100.0 * ex + 7000.0 * ey AS ve, 100.0 * nx + 7000.0 * ny + 500.0 * nz AS vn, 100.0 * ux + 7000.0 * uy + 500.0 * uz AS vu FROM b) SELECT id, round(ve, 4) + 0.0 AS east, round(vn, 4) + 0.0 AS north, round(vu, 4) + 0.0 AS up, round(atan2(ve, vn), 6) + 0.0 AS heading FROM v")
def p37(spark, sf):
    e, n, u = geodesy.enu(F.radians("lon"), F.radians("lat"))
    v = F.lit(100.0), F.lit(7000.0), F.lit(500.0)
    ve, vn, vu = (geodesy.dot(v, k) for k in (e, n, u))
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    return rel.target(spark, sf).select("id", r4(ve).alias("east"), r4(vn).alias("north"), r4(vu).alias("up"), r6(F.atan2(ve, vn)).alias("heading"))


@query("p44_tide_components", "target", f"{_BASIS}, l AS (SELECT *, 0.6 AS lx, -0.48 AS ly, 0.64 AS lz FROM b), d AS (SELECT *, 0.02 * (ex * lx + ey * ly) + 0.05 * (nx * lx + ny * ly + nz * lz) - 0.1 * (ux * lx + uy * ly + uz * lz) AS r FROM l) SELECT id, round(r, 6) + 0.0 AS range FROM d")
def p44(spark, sf):
    basis = geodesy.enu(F.radians("lon"), F.radians("lat"))
    look = F.lit(0.6), F.lit(-0.48), F.lit(0.64)
    r = sum((k * geodesy.dot(b, look) for k, b in zip((0.02, 0.05, -0.1), basis, strict=True)), F.lit(0.0))
    return rel.target(spark, sf).select("id", r6(r).alias("range"))


@query("p46_east_north_vector", "target", f"{_BASIS}{_T.replace(', g AS', ', g AS', 1)}, s AS (SELECT o.id, px - x AS lx, 30000.0 - y AS ly, pz - z AS lz FROM o) SELECT s.id, round((lx * ex + ly * ey) / sqrt(lx * lx + ly * ly + lz * lz), 6) + 0.0 AS east, round((lx * nx + ly * ny + lz * nz) / sqrt(lx * lx + ly * ly + lz * lz), 6) + 0.0 AS north FROM s JOIN b USING (id)")
def p46(spark, sf):
    s = _looks(spark, sf).join(rel.target(spark, sf).select("id", "lon", "lat"), "id")
    e, n, _ = geodesy.enu(F.radians("lon"), F.radians("lat"))
    up = geodesy.minus(_vector("p"), _vector())
    return s.select("id", r6(geodesy.dot(up, e) / geodesy.norm(up)).alias("east"), r6(geodesy.dot(up, n) / geodesy.norm(up)).alias("north"))


@query("j16_radar_to_ground", "target", ", g AS (SELECT id, 7071000.0 + (id % 16) * 10.0 AS px, 780000.0 + (id * 7919 % 500) * 200.0 AS r, (id % 40) * 50.0 AS h FROM target), k AS (SELECT *, (px * px + r * r - pow(6371000.0 + h, 2)) / (2 * px * r) AS q FROM g) SELECT id, round(px - r * q, 3) AS x, CAST(5000.0 AS DOUBLE) AS y, round(r * sqrt(1 - q * q), 3) AS z FROM k")
def j16(spark, sf):
    k = c("id")
    p = rel.target(spark, sf).select("id", (7071000.0 + (k % 16) * 10.0).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("vx"), F.lit(7500.0).alias("vy"), F.lit(0.0).alias("vz"), (780000.0 + (k * 7919 % 500) * 200.0).alias("r"), ((k % 40) * 50.0).alias("h"))
    d = geometry.radar_to_ground(p, 6371000.0)
    return d.select("id", F.round("x", 3).alias("x"), F.round(c("y") + 5000.0, 3).alias("y"), F.round(F.abs("z"), 3).alias("z"))


@query("j31_metadata_cube", "target", f"{_T}, q AS (SELECT id, hh, x + hh AS x, y, z, px, pz FROM o, (VALUES (0.0), (500.0), (1500.0)) h(hh)) SELECT id, CAST(hh AS DOUBLE) AS height, round(y / 7500.0, 5) AS t, round(sqrt(pow(x - px, 2) + pow(z - pz, 2)), 3) AS r FROM q")
def j31(spark, sf):
    t = _scene(spark, sf)
    cube = t.withColumn("height", F.explode(F.array(F.lit(0.0), F.lit(500.0), F.lit(1500.0)))).withColumn("x", c("x") + c("height"))
    return geometry.ground_to_radar(cube, _orbit(spark, t)).select("id", "height", F.round("t", 5).alias("t"), F.round("r", 3).alias("r"))


_SUMMED = (
    ", ce AS (SELECT id, id % 400 AS first, (id % 400) * 5.0 + 75 AS y, 10000.0 + (id % 20) * 300 AS z FROM target), pd AS (SELECT id, p.row AS k, sqrt(pow(6371000.0 - 7071000.0, 2) + pow(y - p.row * 5.0, 2) + z * z) AS d FROM ce JOIN (SELECT DISTINCT row FROM slc) p ON p.row BETWEEN first AND first + 30)"
    ", ps AS (SELECT id, k, d * 4 * pi() / 0.24 AS a, (d - 700000.0) / 25.0 AS s FROM pd), pv AS (SELECT id, a, u.re * (1 - (s - floor(s))) + v.re * (s - floor(s)) AS re, u.im * (1 - (s - floor(s))) + v.im * (s - floor(s)) AS im FROM ps JOIN slc u ON u.row = k AND u.col = floor(s) JOIN slc v ON v.row = k AND v.col = floor(s) + 1)"
)


@query("j29_back_projection", "slc target", f"{_SUMMED} SELECT id, count(*) AS n, round(sum(re * cos(a) - im * sin(a)), 4) + 0.0 AS re, round(sum(re * sin(a) + im * cos(a)), 4) + 0.0 AS im FROM pv GROUP BY id")
def j29(spark, sf):
    """Image lines as pulses along the track, targets as cells; each sums the pulses of its aperture."""
    from echogrid.operators.lines import to_lines

    pulses = to_lines(rel.slc(spark, sf), ["row"]).select(F.lit(0).alias("scene"), c("row").alias("k"), F.lit(7071000.0).alias("px"), (c("row") * 5.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(700000.0).alias("r0"), "re", "im")
    cells = rel.target(spark, sf).select(F.lit(0).alias("scene"), "id", (c("id") % 400).alias("first"), (c("id") % 400 + 30).alias("last"), F.lit(6371000.0).alias("x"), ((c("id") % 400) * 5.0 + 75).alias("y"), (10000.0 + (c("id") % 20) * 300).alias("z"))
    d = geometry.back_project(cells, pulses, ["scene"], 25.0, 0.24)
    return d.select("id", "n", (F.round("re", 4) + F.lit(0.0)).alias("re"), (F.round("im", 4) + F.lit(0.0)).alias("im"))


@query("p48_aperture_duration", "target", f"{_T} SELECT id, round(0.24 / (2 * 7.0) * sqrt(pow(x - px, 2) + pow(z - pz, 2)) / (7500.0 * 6371000.0 / px), 6) AS seconds FROM o")
def p48(spark, sf):
    t = _scene(spark, sf)
    px = 7071000.0 + c("orbit_id") * 10.0
    done = geometry.ground_to_radar(t, _orbit(spark, t))
    return done.select("id", F.round(geometry.aperture_seconds(c("r"), 7500.0 * 6371000.0 / px, 0.24, 7.0), 6).alias("seconds"))


@query("a49_grid_spacing", "target", f"{_T}, e AS (SELECT orbit_id, 50.0 / 7500.0 AS dt, abs(sqrt(pow(x - px, 2) + pow(z + 50 - pz, 2)) - sqrt(pow(x - px, 2) + pow(z - 50 - pz, 2))) / 2 AS dr FROM o) SELECT orbit_id, CAST(round(min(dt), 7) AS DOUBLE) AS dt, round(min(dr), 4) AS dr FROM e GROUP BY orbit_id")
def a49(spark, sf):
    t = _scene(spark, sf)
    d = geometry.corner_spacing(t, _orbit(spark, t), 50.0, ["orbit_id"])
    return d.select("orbit_id", F.round("dt", 7).alias("dt"), F.round("dr", 4).alias("dr"))


@query("j28_reskew", "target", f"{_T} SELECT id, round(y / 7500.0, 5) AS t, round(sqrt(pow(x - px, 2) + pow(z - pz, 2)), 2) AS r FROM o")
def j28(spark, sf):
    """Radar to ground at each crossing, and back: times and ranges stay."""
    t = _scene(spark, sf)
    orbit = _orbit(spark, t)
    first = geometry.ground_to_radar(t, orbit)
    k = c("orbit_id")
    state = {"px": 7071000.0 + k * 10.0, "py": c("t") * V[1], "pz": -300000.0 - k * 500.0, "vx": F.lit(V[0]), "vy": F.lit(V[1]), "vz": F.lit(V[2])}
    points = first.select("id", "orbit_id", "r", *(v.alias(n) for n, v in state.items()), (geodesy.norm(_vector()) - 6371000.0).alias("h"), F.when(c("z") > -300000.0 - k * 500.0, 1).otherwise(-1).alias("side"))
    ground = geometry.radar_to_ground(points, 6371000.0, c("side")).select("id", "orbit_id", "x", "y", "z")
    return geometry.ground_to_radar(ground, orbit).select("id", F.round("t", 5).alias("t"), F.round("r", 2).alias("r"))


@query("a39_scene_bounds", "target", ", g AS (SELECT id % 20 AS scene, 7071000.0 + (id % 16) * 10.0 AS px, 780000.0 + (id * 7919 % 500) * 200.0 AS r, h FROM target, (VALUES (0.0), (2000.0)) v(hh)), k AS (SELECT scene, px, r, (px * px + r * r - pow(6371000.0 + hh, 2)) / (2 * px * r) AS q FROM (SELECT id % 20 AS scene, 7071000.0 + (id % 16) * 10.0 AS px, 780000.0 + (id * 7919 % 500) * 200.0 AS r, hh FROM target, (VALUES (0.0), (2000.0)) v(hh)) t), a AS (SELECT scene, degrees(atan2(r * sqrt(1 - q * q), px - r * q)) AS a FROM k) SELECT scene, round(min(a), 6) AS near, round(max(a), 6) AS far FROM a GROUP BY scene")
def a39(spark, sf):
    k = c("id")
    p = rel.target(spark, sf).select((k % 20).alias("scene"), (7071000.0 + (k % 16) * 10.0).alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("vx"), F.lit(7500.0).alias("vy"), F.lit(0.0).alias("vz"), (780000.0 + (k * 7919 % 500) * 200.0).alias("r"), F.explode(F.array(F.lit(0.0), F.lit(2000.0))).alias("h"))
    a = geometry.radar_to_ground(p, 6371000.0).select("scene", F.degrees(F.atan2(F.abs("z"), c("x"))).alias("a"))
    return a.groupBy("scene").agg(F.round(F.min("a"), 6).alias("near"), F.round(F.max("a"), 6).alias("far"))


@query("l9_baseline_layers", "target", f"{_T}, q AS (SELECT id, hh, x + hh - px AS lx, z - pz AS lz FROM o, (VALUES (0.0), (1000.0)) h(hh)), k AS (SELECT *, (120.0 * lx - 80.0 * lz) / sqrt(lx * lx + lz * lz) AS par, -120.0 * lz - 80.0 * lx AS side FROM q) SELECT id, CAST(hh AS DOUBLE) AS height, round(par, 3) + 0.0 AS parallel, round(sqrt(20800.0 - par * par) * CASE WHEN side < 0 THEN -1.0 ELSE 1.0 END, 3) + 0.0 AS perpendicular FROM k")
def l9(spark, sf):
    """Baselines of an image pair on a cube of heights: zero-Doppler crossing, then the difference of the two orbits."""
    t = _scene(spark, sf)
    cube = t.withColumn("height", F.explode(F.array(F.lit(0.0), F.lit(1000.0)))).withColumn("x", c("x") + c("height"))
    j = geometry.ground_to_radar(cube, _orbit(spark, t))
    k = c("orbit_id")
    j = j.withColumns({"px": 7071000.0 + k * 10.0, "py": c("t") * V[1], "pz": -300000.0 - k * 500.0, "vx": F.lit(V[0]), "vy": F.lit(V[1]), "vz": F.lit(V[2])})
    par, perp = geometry.baselines(_vector("p"), _vector("v"), (c("px") + 120.0, c("py") + 55.0, c("pz") - 80.0), _vector())
    r3 = lambda x: F.round(x, 3) + F.lit(0.0)
    return j.select("id", "height", r3(par).alias("parallel"), r3(perp).alias("perpendicular"))


@query("p44_tide_range_azimuth", "target", f"{_BASIS}, l AS (SELECT *, 0.6 AS lx, -0.48 AS ly, 0.64 AS lz, (id % 7) / 7.0 AS u FROM b), w AS (SELECT *, 0.02 + u * 0.03 AS de, 0.05 - u * 0.02 AS dn, -0.1 + u * 0.04 AS du FROM l), d AS (SELECT id, de * (ex * lx + ey * ly) + dn * (nx * lx + ny * ly + nz * lz) + du * (ux * lx + uy * ly + uz * lz) AS r, (de * (100.0 * ex + 7000.0 * ey) + dn * (100.0 * nx + 7000.0 * ny + 500.0 * nz) + du * (100.0 * ux + 7000.0 * uy + 500.0 * uz)) / sqrt({100.0**2 + 7000.0**2 + 500.0**2}) AS a FROM w) SELECT id, round(r, 6) + 0.0 AS range, round(a, 6) + 0.0 AS azimuth FROM d")
def p44_both(spark, sf):
    """Displacements at two whole seconds, in between by a straight line, along the line of sight and along the track."""
    k = c("id") % 7 / 7.0
    between = geometry.between((0.02, 0.05, -0.1), (0.05, 0.03, -0.06), k)
    basis = geodesy.enu(F.radians("lon"), F.radians("lat"))
    r, a = geometry.displacement(between, basis, (F.lit(0.6), F.lit(-0.48), F.lit(0.64)), (F.lit(100.0), F.lit(7000.0), F.lit(500.0)))
    return rel.target(spark, sf).select("id", r6(r).alias("range"), r6(a).alias("azimuth"))
