"""Radar coordinates of a native Doppler: ground places, moves to zero Doppler, speeds over the ground, scene outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.functions import geodesy
from echogrid.functions.geodesy import dot, norm
from echogrid.operators import asof, geometry, grid, mapping
from echogrid.operators.mapping import vector
from echogrid.shared import spread

c = F.col


def with_state(points: DataFrame, orbit: DataFrame, key: str = "orbit_id") -> DataFrame:
    """``points`` (``key, t``) with ``px..vz``, the platform at that time; null where the orbit has no states around it.

    Positions and velocities are Hermite polynomials of the two states of the orbit's array that hold the time.
    """
    d = points.join(orbit.select(key, "states"), key, "left")
    pairs = F.arrays_zip(F.slice("states", F.lit(1), F.greatest(F.size("states") - 1, F.lit(0))).alias("a"), F.slice("states", F.lit(2), F.greatest(F.size("states") - 1, F.lit(0))).alias("b"))
    holds = lambda s: (s["a"]["t"] <= c("t")) & (c("t") <= s["b"]["t"])
    d = d.withColumn("_s", F.get(F.filter(pairs, holds), F.lit(0))).drop("states")
    a, b = c("_s.a"), c("_s.b")
    d = d.withColumns({"_h": b["t"] - a["t"], "_u": (c("t") - a["t"]) / (b["t"] - a["t"])})
    found = {}
    for k in "xyz":
        found[f"p{k}"], found[f"v{k}"] = asof.hermite(c("_u"), c("_h"), a[f"p{k}"], a[f"v{k}"], b[f"p{k}"], b[f"v{k}"])
    return d.withColumns(found).drop("_s", "_h", "_u")


def radar_to_ground(points: DataFrame, wavelength: float, dem=None, rounds: int = mapping.ROUNDS) -> DataFrame:
    """``points`` (``px..vz, r, h, side, doppler``) with their places on the ellipsoid, left (1) or right (-1) of the track.

    A Doppler frequency fixes the part of the line of sight along the track; the rest is the
    zero-Doppler problem of a platform moved along it by that much, at the range that is left. Null where
    no direction has that frequency.
    """
    share = c("doppler") * (wavelength / 2) / norm(vector("v"))
    d = points.withColumn("_s", F.when(F.abs(share) <= 1, share))
    kept = {f"_{k}": c(k) for k in ("px", "py", "pz", "r")}
    step = c("r") * c("_s") / norm(vector("v"))
    moved = {f"p{k}": c(f"p{k}") + c("_m") * c(f"v{k}") for k in "xyz"} | {"r": c("r") * F.sqrt(1 - c("_s") ** 2)}
    d = mapping.radar_to_ground(d.withColumns(kept | {"_m": step}).withColumns(moved), dem, rounds)
    return d.withColumns({k[1:]: c(k) for k in kept}).drop(*kept, "_s", "_m")


def reskew(points: DataFrame, table: DataFrame, orbit: DataFrame, axes: tuple[float, float, float, float], shape: tuple[int, int], wavelength: float, key: str = "orbit_id", dem=None) -> DataFrame:
    """``points`` (``key, id, t, r, h, side``) with their ``doppler``, ``t_zero`` and ``r_zero``: time and range at which zero Doppler sees them.

    ``table``: ``key, row, col, v``, the native Doppler over ``axes`` (first time, step, first
    range, step) of that ``shape``, read bilinearly and clamped at its edges. Null where the orbit does not
    reach. A table of such points over both axes is the look-up table of the move.
    """
    t0, dt, r0, dr = axes
    at = points.withColumns({"y": (c("t") - t0) / dt, "x": (c("r") - r0) / dr})
    d = grid.interpolate(at, table, [key], "bilinear", "v", shape).withColumnRenamed("v", "doppler").drop("x", "y")
    ground = radar_to_ground(with_state(d, orbit, key), wavelength, dem)
    own = {"t": "_time", "r": "_range"}
    seen = geometry.ground_to_radar(ground.withColumnsRenamed(own).drop(*(f"{a}{k}" for a in "pv" for k in "xyz"), "lon", "lat"), orbit, key)
    return seen.withColumnsRenamed({"t": "t_zero", "r": "r_zero"}).withColumnsRenamed({v: k for k, v in own.items()}).drop("x", "y", "z")


def track_speeds(points: DataFrame) -> DataFrame:
    """``points`` (``px..vz``) with ``heading``, ``height``, ``speed`` along the track at the platform's height and ``ground_speed`` below it.

    The part of the velocity along the ellipsoid's normal is left out; the radius is the
    ellipsoid's in the direction of the heading.
    """
    lon, lat, h = geodesy.to_llh(*vector("p"))
    d = points.withColumns({"_lon": lon, "_lat": lat, "height": h})
    e, n, u = geodesy.enu(c("_lon"), c("_lat"))
    d = d.withColumns({"_e": dot(vector("v"), e), "_n": dot(vector("v"), n), "_u": dot(vector("v"), u)})
    level = tuple(c(f"v{k}") - c("_u") * q for k, q in zip("xyz", u, strict=True))
    d = d.withColumns({"heading": F.atan2("_e", "_n"), "speed": norm(level)})
    east, north = geodesy.r_east(c("_lat")), geodesy.r_north(c("_lat"))
    d = d.withColumn("_a", east * north / (east * F.cos("heading") ** 2 + north * F.sin("heading") ** 2))
    return d.withColumn("ground_speed", c("speed") / (1 + c("height") / c("_a"))).drop("_lon", "_lat", "_e", "_n", "_u", "_a")


def perimeter(scenes: DataFrame, orbit: DataFrame, per_edge: int, heights: list[float], wavelength: float, key: str = "orbit_id") -> DataFrame:
    """``id, height, k, lon, lat`` (degrees): the outlines of radar grids (``id, key, t0, t1, r0, r1, side, doppler``) at several heights.

    Outlines start at the first time and range and run so that the scene lies to their left
    on the ground: along the track first if the radar looks left, along the range first if it looks right.
    An edge has ``per_edge`` points with both its ends; the ring is closed by its first point, which is not repeated.
    """
    if per_edge < 2:
        raise ValueError("an edge has two points at least")
    steps = per_edge - 1
    d = spread(scenes, "id").withColumn("height", F.explode(F.array(*(F.lit(float(h)) for h in heights)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4 * steps - 1))))
    edge, share = F.floor(c("k") / steps), (c("k") % steps) / F.lit(float(steps))
    out = F.when(edge == 0, share).when(edge == 1, 1.0).when(edge == 2, 1 - share).otherwise(0.0)
    side = F.when(edge == 0, 0.0).when(edge == 1, share).when(edge == 2, 1.0).otherwise(1 - share)
    left = c("side") > 0
    d = d.withColumns({"_y": F.when(left, out).otherwise(side), "_x": F.when(left, side).otherwise(out)})
    d = d.select("id", key, "height", "k", "side", "doppler", c("height").alias("h"), (c("t0") + c("_y") * (c("t1") - c("t0"))).alias("t"), (c("r0") + c("_x") * (c("r1") - c("r0"))).alias("r"))
    g = radar_to_ground(with_state(d, orbit, key), wavelength)
    return g.select("id", "height", "k", F.degrees("lon").alias("lon"), F.degrees("lat").alias("lat"))


def bounds(outlines: DataFrame, margin: float = 0.0) -> DataFrame:
    """``id, west, east, south, north`` of outlines at all their heights, with a margin in degrees.

    Longitudes more than half a turn apart lie on both sides of the antimeridian: then those below zero
    count a turn more, and ``east`` is beyond 180. Latitudes stop at the poles. A scene with a point
    that its orbit or range does not reach has null bounds.
    """
    up = F.when(c("lon") < 0, c("lon") + 360).otherwise(c("lon"))
    whole = F.count("lon") == F.count("*")
    g = outlines.groupBy("id").agg(F.min("lon").alias("_a"), F.max("lon").alias("_b"), F.min(up).alias("_c"), F.max(up).alias("_d"), F.min("lat").alias("_s"), F.max("lat").alias("_n"), whole.alias("_whole"))
    over = c("_b") - c("_a") > 180
    found = {
        "west": F.when(over, c("_c")).otherwise(c("_a")) - margin,
        "east": F.when(over, c("_d")).otherwise(c("_b")) + margin,
        "south": F.greatest(c("_s") - margin, F.lit(-90.0)),
        "north": F.least(c("_n") + margin, F.lit(90.0)),
    }
    return g.select("id", *(F.when(c("_whole"), v).alias(k) for k, v in found.items()))

