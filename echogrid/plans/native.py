"""Native Doppler, speeds over the ground and scene outlines over the straight track of the map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from echogrid.functions import geodesy
from echogrid.operators import geometry, native
from echogrid.plans import mapping as onmap
from echogrid.plans import relations as rel
from echogrid.plans.registry import query

c = F.col
P0, V, WAVE = onmap.P0, onmap.V, onmap.WAVE
A, B, E2 = geodesy.A, geodesy.B, geodesy.E2
#: Axes of the Doppler table: first time, step, first range, step; and its shape.
AXES, SHAPE = (0.0, 10.0, 770_000.0, 10_000.0), (10, 9)


def _points(spark, sf):
    k = c("id")
    return rel.target(spark, sf).select("id", (k % 4).alias("orbit_id"), (20.25 + k * 13 % 40).cast("double").alias("t"), (775_000.0 + (k * 7919 % 600) * 100.0).alias("r"), ((k % 13) * 80.0).alias("h"), F.when(k % 3 == 0, -1).otherwise(1).alias("side"))


_POINTS = ", q AS (SELECT id, id % 4 AS orbit_id, CAST(20.25 + id * 13 % 40 AS DOUBLE) AS t, 775000.0 + (id * 7919 % 600) * 100.0 AS r FROM target)"


def _doppler(points):
    """The native Doppler of each orbit, a product of straight lines in time and range."""
    cells = points.select("orbit_id").distinct().select("orbit_id", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[0] - 1)).cast("array<bigint>")).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[1] - 1))))
    return cells.withColumn("v", (300 + 20 * c("orbit_id") + 5 * c("row") - 8 * c("col") + 2 * c("row") * c("col")).cast("double"))


@query("j28_native_doppler", "target", f"{_POINTS}, y AS (SELECT *, (t - {AXES[0]}) / {AXES[1]} AS y, (r - {AXES[2]}) / {AXES[3]} AS x FROM q), f AS (SELECT *, 300 + 20 * orbit_id + 5 * y - 8 * x + 2 * x * y AS f FROM y), s AS (SELECT *, f * {WAVE} / 15000 AS s FROM f) SELECT id, round(f, 5) AS doppler, round(t + r * s / 7500, 5) AS t, round(r * sqrt(1 - s * s), 3) AS r FROM s")
def j28_native(spark, sf):
    """From the native Doppler of a table to the ground on the ellipsoid, and from there to zero Doppler; along a straight track the move is known."""
    p = _points(spark, sf)
    d = native.reskew(p, _doppler(p), onmap._orbit(spark, p), AXES, SHAPE, WAVE)
    return d.select("id", F.round("doppler", 5).alias("doppler"), F.round("t_zero", 5).alias("t"), F.round("r_zero", 3).alias("r"))


_FLAT = f"atan2(z + {E2 / (1 - E2) * B} * pow(sin({{0}}), 3), p - {E2 * A} * pow(cos({{0}}), 3))"
_LLH = f"b{{0}} AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {A}, sqrt(x * x + y * y) * {B}) AS bt, atan2(y, x) AS lon FROM {{1}}), c{{0}} AS (SELECT *, {_FLAT.format('bt')} AS la FROM b{{0}}), d{{0}} AS (SELECT *, {_FLAT.format(f'atan2(sin(la) * {B / A}, cos(la))')} AS lat FROM c{{0}})"
_SPEED = (
    f"{_POINTS}, st AS (SELECT *, {P0[0]} + orbit_id * 100 + t * {V[0]} AS x, {P0[1]} + t * {V[1]} AS y, {P0[2]} + t * {V[2]} AS z FROM q), {_LLH.format('', 'st')}"
    f", e AS (SELECT *, p * cos(lat) + z * sin(lat) - {A} * sqrt(1 - {E2} * pow(sin(lat), 2)) AS height, -sin(lon) * {V[0]} + cos(lon) * {V[1]} AS ve, -sin(lat) * cos(lon) * {V[0]} - sin(lat) * sin(lon) * {V[1]} + cos(lat) * {V[2]} AS vn FROM d)"
    f", g AS (SELECT *, sqrt(ve * ve + vn * vn) AS speed, atan2(ve, vn) AS heading, {A} / sqrt(1 - {E2} * pow(sin(lat), 2)) AS re, {A * (1 - E2)} / pow(1 - {E2} * pow(sin(lat), 2), 1.5) AS rn FROM e), o AS (SELECT *, speed / (1 + height / (re * rn / (re * pow(cos(heading), 2) + rn * pow(sin(heading), 2)))) AS ground FROM g)"
)


@query("p48_track_speeds", "target", f"{_SPEED} SELECT id, round(heading, 7) + 0.0 AS heading, round(speed, 4) AS speed, round(ground, 4) AS ground_speed, round({WAVE} / 14 * r / ground, 6) AS seconds FROM o")
def p48_speeds(spark, sf):
    """Speeds of the platform from its orbit, along the track and over the ground, and the synthetic aperture's duration."""
    p = _points(spark, sf)
    d = native.track_speeds(native.with_state(p, onmap._orbit(spark, p)))
    seconds = geometry.aperture_seconds(c("r"), c("ground_speed"), WAVE, 7.0)
    return d.select("id", (F.round("heading", 7) + F.lit(0.0)).alias("heading"), F.round("speed", 4).alias("speed"), F.round("ground_speed", 4).alias("ground_speed"), F.round(seconds, 6).alias("seconds"))


#: Points of an edge, heights and the margin in degrees.
PER_EDGE, HEIGHTS, MARGIN = 4, (-50.0, 3000.0), 0.05
_T = tuple(v / 7500.0 for v in V)


def _rounds(n: int) -> str:
    """Ground places of ``w0`` (unit vectors n, e, depth dd, range rr, height hh) in so many rounds, each with the sphere through the last place."""
    out = ""
    for i in range(n):
        out += (
            f", k{i} AS (SELECT *, ((big * big - qq) / (2 * rr) - rr / 2) / dd AS kk FROM w{i}), x{i} AS (SELECT id, hh, ax, ay, az, nx, ny, nz, ex, ey, ez, dd, rr, qq, ax - rr * (kk * nx + sd * sqrt(1 - kk * kk) * ex) AS x, ay - rr * (kk * ny + sd * sqrt(1 - kk * kk) * ey) AS y, az - rr * (kk * nz + sd * sqrt(1 - kk * kk) * ez) AS z, sd FROM k{i}), {_LLH.format(f'_{i}', f'x{i}')}"
            f", w{i + 1} AS (SELECT id, hh, sd, ax, ay, az, nx, ny, nz, ex, ey, ez, dd, rr, qq, lon, lat, sqrt(pow(({A} / sqrt(1 - {E2} * pow(sin(lat), 2)) + hh) * cos(lat), 2) + pow(({A * (1 - E2)} / sqrt(1 - {E2} * pow(sin(lat), 2)) + hh) * sin(lat), 2)) AS big FROM d_{i})"
        )
    return out


_EDGES = PER_EDGE - 1
_OUTLINE = (
    ", sc AS (SELECT id, id % 4 AS orbit_id, CAST(20 + id % 10 AS DOUBLE) AS t0, CAST(25 + id % 17 AS DOUBLE) AS t1, 780000.0 + (id * 7919 % 100) * 200.0 AS r0, 830000.0 + (id % 5) * 5000.0 AS r1, CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END AS sd, CAST(id % 7 * 100 AS DOUBLE) AS f FROM target)"
    f", pe AS (SELECT sc.*, hh, k // {_EDGES} AS e, (k % {_EDGES}) / {_EDGES}.0 AS u FROM sc, range(0, {4 * _EDGES}) t(k), (VALUES (-50.0), (3000.0)) h(hh)), pq AS (SELECT *, CASE e WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN 1 - u ELSE 0 END AS o, CASE e WHEN 0 THEN 0 WHEN 1 THEN u WHEN 2 THEN 1 ELSE 1 - u END AS s FROM pe)"
    f", pt AS (SELECT id, orbit_id, CAST(hh AS DOUBLE) AS hh, sd, f * {WAVE} / 15000 AS q, t0 + CASE WHEN sd > 0 THEN o ELSE s END * (t1 - t0) AS t, r0 + CASE WHEN sd > 0 THEN s ELSE o END * (r1 - r0) AS r FROM pq)"
    f", pp AS (SELECT id, hh, sd, r * sqrt(1 - q * q) AS rr, {P0[0]} + orbit_id * 100 + t * {V[0]} + r * q * {_T[0]} AS ax, {P0[1]} + t * {V[1]} + r * q * {_T[1]} AS ay, {P0[2]} + t * {V[2]} + r * q * {_T[2]} AS az FROM pt)"
    f", pl AS (SELECT *, ax * {_T[0]} + ay * {_T[1]} + az * {_T[2]} AS al, ax * ax + ay * ay + az * az AS qq FROM pp), pd AS (SELECT *, sqrt(qq - al * al) AS dd FROM pl), pn AS (SELECT *, (al * {_T[0]} - ax) / dd AS nx, (al * {_T[1]} - ay) / dd AS ny, (al * {_T[2]} - az) / dd AS nz FROM pd)"
    f", w0 AS (SELECT *, ny * {_T[2]} - nz * {_T[1]} AS ex, nz * {_T[0]} - nx * {_T[2]} AS ey, nx * {_T[1]} - ny * {_T[0]} AS ez, {A} + hh AS big FROM pn)"
)


@query("a39_ellipsoid_bounds", "target", f"{_OUTLINE}{_rounds(6)} SELECT id, round(degrees(min(lon)) - {MARGIN}, 6) AS west, round(degrees(max(lon)) + {MARGIN}, 6) AS east, round(degrees(min(lat)) - {MARGIN}, 6) AS south, round(degrees(max(lat)) + {MARGIN}, 6) AS north FROM w6 GROUP BY id")
def a39_bounds(spark, sf):
    """Bounding boxes of radar grids on the ellipsoid, from their outlines at the least and the greatest height."""
    k = c("id")
    scenes = rel.target(spark, sf).select("id", (k % 4).alias("orbit_id"), (20 + k % 10).cast("double").alias("t0"), (25 + k % 17).cast("double").alias("t1"), (780_000.0 + (k * 7919 % 100) * 200.0).alias("r0"), (830_000.0 + (k % 5) * 5000.0).alias("r1"), F.when(k % 3 == 0, -1).otherwise(1).alias("side"), (k % 7 * 100).cast("double").alias("doppler"))
    outlines = native.perimeter(scenes, onmap._orbit(spark, scenes), PER_EDGE, list(HEIGHTS), WAVE)
    return native.bounds(outlines, MARGIN).select("id", *(F.round(x, 6).alias(x) for x in ("west", "east", "south", "north")))
