"""Images on maps: ground points with heights, geometry layers, geocoding, facets and antenna angles.

A map is a table of points (``lon, lat, h``, radians and metres) that is joined to its orbit by a
key; every step is a projection or an equi-join, so points and images may be of any size.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions import cplx, geodesy
from echogrid.functions.geodesy import Vector, cross, dot, minus, norm
from echogrid.operators import asof, footprint, geometry, grid, neighbours

c = F.col
#: Rounds in which the height and the ellipsoid's radius below a point are renewed; each gains two digits or more.
ROUNDS = 6


def vector(kind: str = "") -> Vector:
    return c(f"{kind}x"), c(f"{kind}y"), c(f"{kind}z")


def on_surface(points: DataFrame, a: Vector, b: Vector, side: Column, dem=None, rounds: int = ROUNDS) -> DataFrame:
    """``points`` (``px, py, pz, r, h``) with ``x, y, z, lon, lat, h``: the place at range r from P in the plane of the unit vectors a and b, at height h over the ellipsoid.

    On a sphere the angle from a is that of the plane's nearest direction to the centre plus or
    minus (``side``) an arc cosine. The sphere is the one through the place below at its height,
    renewed in a fixed number of rounds. ``dem``: a function that adds ``h`` to points with ``lon,
    lat`` (a join, one a round); else h stays.
    """
    p = vector("p")
    if dem is None:
        given = F.struct(*(x.cast("double").alias(f"k{i}") for i, x in enumerate((*p, c("r"), *a, *b, c("h"), side))))
        d = points.withColumn("_g", _surface(rounds)(given))
        return d.withColumns({k: c(f"_g.{k}") for k in ("x", "y", "z", "lon", "lat")}).drop("_g")
    names = [f"_{k}{i}" for k in "ab" for i in range(3)] + ["_pa", "_pb", "_side", "_big"]
    d = points.withColumns(dict(zip(names, (*a, *b, dot(p, a), dot(p, b), side.cast("double"), F.lit(geodesy.A) + c("h")), strict=True)))
    for _ in range(rounds):
        k = (c("_big") ** 2 - dot(p, p) - c("r") ** 2) / (2 * c("r"))
        d = d.withColumn("_t", F.atan2("_pb", "_pa") + c("_side") * F.acos(F.greatest(F.least(k / F.hypot("_pa", "_pb"), F.lit(1.0)), F.lit(-1.0))))
        d = d.withColumns({n: q + c("r") * (F.cos("_t") * c(f"_a{i}") + F.sin("_t") * c(f"_b{i}")) for i, (n, q) in enumerate(zip("xyz", p, strict=True))})
        d = with_llh(d)
        if dem is not None:
            d = dem(d)
        below = geodesy.to_xyz(c("lon"), c("lat"), c("h"))
        d = d.withColumn("_big", norm(below))
    return d.drop(*names, "_t")


def _surface(rounds: int):
    """The rounds of ``on_surface`` at fixed heights, a batch of points at a time: as columns they make one method too long to be compiled."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.to_numpy(float, na_value=np.nan).T
        p, r, a, b, h, side = v[0:3], v[3], v[4:7], v[7:10], v[10], v[11]
        pa, pb, pp, big = (p * a).sum(axis=0), (p * b).sum(axis=0), (p * p).sum(axis=0), geodesy.A + h
        ep2 = geodesy.E2 / (1 - geodesy.E2)
        for _ in range(rounds):
            k = (big**2 - pp - r**2) / (2 * r)
            t = np.arctan2(pb, pa) + side * np.arccos(np.clip(k / np.hypot(pa, pb), -1.0, 1.0))
            x, y, z = p + r * (np.cos(t) * a + np.sin(t) * b)
            lon, q = np.arctan2(y, x), np.hypot(x, y)
            n = np.arctan2(z * geodesy.A, q * geodesy.B)
            for _ in range(2):
                lat = np.arctan2(z + ep2 * geodesy.B * np.sin(n) ** 3, q - geodesy.E2 * geodesy.A * np.cos(n) ** 3)
                n = np.arctan2(np.sin(lat) * (geodesy.B / geodesy.A), np.cos(lat))
            s = np.sin(lat)
            east = geodesy.A / np.sqrt(1 - geodesy.E2 * s * s)
            big = np.hypot((east + h) * np.cos(lat), (east * (1 - geodesy.E2) + h) * s)
        return pd.DataFrame({"x": x, "y": y, "z": z, "lon": lon, "lat": lat})

    return F.pandas_udf(run, "x double, y double, z double, lon double, lat double")


def with_llh(d: DataFrame) -> DataFrame:
    """``lon, lat`` of ``x, y, z``, step by step so that no expression repeats."""
    d = d.withColumns({"lon": F.atan2("y", "x"), "_p": F.hypot("x", "y")}).withColumn("_n", F.atan2(c("z") * geodesy.A, c("_p") * geodesy.B))
    ep2 = geodesy.E2 / (1 - geodesy.E2)
    for _ in range(2):
        d = d.withColumn("lat", F.atan2(c("z") + ep2 * geodesy.B * F.sin("_n") ** 3, c("_p") - geodesy.E2 * geodesy.A * F.cos("_n") ** 3))
        d = d.withColumn("_n", F.atan2(F.sin("lat") * (geodesy.B / geodesy.A), F.cos("lat")))
    return d.drop("_p", "_n")


def radar_to_ground(points: DataFrame, dem=None, rounds: int = ROUNDS) -> DataFrame:
    """Zero-Doppler places on the ellipsoid (``px..vz, r, h, side``), left (1) or right (-1) of the track; see ``on_surface``."""
    p, v = vector("p"), vector("v")
    speed = norm(v)
    t = tuple(k / speed for k in v)
    along = dot(p, t)
    n = tuple(along * k - q for k, q in zip(t, p, strict=True))
    d = points.withColumns({f"_n{k}": q / norm(n) for k, q in zip("xyz", n, strict=True)}).withColumns({f"_c{k}": q for k, q in zip("xyz", cross(vector("_n"), t), strict=True)})
    # Nadir is the plane's direction nearest to the centre, so the side is the sign.
    return on_surface(d, vector("_n"), vector("_c"), c("side"), dem, rounds).drop(*(f"_{a}{k}" for a in "nc" for k in "xyz"))


def layers(points: DataFrame, orbit: DataFrame, key: str = "orbit_id") -> DataFrame:
    """``points`` (``key, lon, lat, h``) with zero-Doppler ``t, r``, incidence, elevation and the line of sight and track in east and north.

    ``incidence``: between the normal and the direction to the platform; ``elevation``: between
    the platform's nadir and the line of sight; ``los_e, los_n``: of the unit vector to the
    platform; ``track_e, track_n``: of the platform's direction; ``ground_speed``: of its shadow.
    """
    x = dict(zip("xyz", geodesy.to_xyz(c("lon"), c("lat"), c("h")), strict=True))
    d = geometry.ground_to_radar(points.withColumns(x), orbit, key, state=True)
    e, n, u = geodesy.enu(c("lon"), c("lat"))
    los = tuple(k / c("r") for k in minus(vector("p"), vector()))
    d = d.withColumns({f"_l{k}": q for k, q in zip("xyz", los, strict=True)} | {"_v": norm(vector("v")), "_q": norm(vector("p"))})
    look = vector("_l")
    track = tuple(k / c("_v") for k in vector("v"))
    out = {
        "incidence": F.acos(dot(look, u)),
        "elevation": F.acos(dot(look, vector("p")) / c("_q")),
        "los_e": dot(look, e),
        "los_n": dot(look, n),
        "track_e": dot(track, e),
        "track_n": dot(track, n),
        "ground_speed": c("_v") * norm(vector()) / c("_q"),
    }
    return d.withColumns(out).drop("_lx", "_ly", "_lz", "_v", "_q")


def image_places(points: DataFrame, t0: float, prf: float, r0: float, spacing: float) -> DataFrame:
    """Points of ``t, r`` with their places ``y, x`` on the radar grid; null for those of no crossing (a filter here would be pushed into the join with the whole crossing)."""
    return points.withColumns({"y": (c("t") - t0) * prf, "x": (c("r") - r0) / spacing})


def geocode(places: DataFrame, image: DataFrame, keys: list[str], values: list[str], method: str = "bilinear") -> DataFrame:
    """Map points at ``y, x`` of the radar grid (``keys, id``) with the image's values there, null where a needed cell is missing."""
    return grid.interpolate(places, image, keys, method, values)


def geocode_complex(places: DataFrame, image: DataFrame, keys: list[str], wavelength: float, carrier: float = 0.0, method: str = "sinc") -> DataFrame:
    """Phase-preserving geocoding: the image without its range carrier (radians a cell), interpolated, with the carrier put back and the two-way phase of the range taken off."""
    down = cplx.rotate(cplx.pair(), -carrier * c("col"))
    flat = image.select(*keys, "row", "col", down[0].alias("re"), down[1].alias("im"))
    d = geocode(places, flat, keys, ["re", "im"], method)
    up = cplx.rotate(cplx.pair(), carrier * c("x") + c("r") * (4 * math.pi / wavelength))
    return d.withColumns({"re": up[0], "im": up[1]})


def polynomial(terms: dict[tuple[int, int], float], y: Column, x: Column) -> Column:
    """The sum of ``terms[i, j] y^i x^j``."""
    power = lambda k, n: reduce(lambda a, b: a * b, [k] * n, F.lit(1.0))
    return sum((power(y, i) * power(x, j) * v for (i, j), v in terms.items()), F.lit(0.0))


def resample(places: DataFrame, image: DataFrame, keys: list[str], carrier: dict[tuple[int, int], float], method: str = "sinc", flatten: Column | None = None) -> DataFrame:
    """A complex image at ``y, x`` (``keys, id``), with a carrier whose phase is a polynomial of row and column.

    The carrier is taken off the cells, which are then slow enough to be interpolated, and put
    back at the place itself. ``flatten``: a phase to take off each place besides. Null where a needed cell is missing.
    """
    down = cplx.rotate(cplx.pair(), -polynomial(carrier, c("row").cast("double"), c("col").cast("double")))
    flat = image.select(*keys, "row", "col", down[0].alias("re"), down[1].alias("im"))
    d = grid.interpolate(places, flat, keys, method, ["re", "im"])
    phase = polynomial(carrier, c("y"), c("x"))
    up = cplx.rotate(cplx.pair(), phase if flatten is None else phase - flatten)
    return d.withColumns({"re": up[0], "im": up[1]})


def facets(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells between DEM nodes (``keys, row, col, lon, lat, h``): centre ``x, y, z`` and area vector ``ax, ay, az`` (two triangles)."""
    d = nodes.withColumns(dict(zip("xyz", geodesy.to_xyz(c("lon"), c("lat"), c("h")), strict=True)))
    d = d.withColumn("_n", F.struct("x", "y", "z"))
    d = neighbours.blocked(d, 1, keys).withColumns({"_r": F.lead("_n").over(neighbours.along(keys)), "_d": F.lead("_n").over(neighbours.across(keys))})
    d = neighbours.owned(d.withColumn("_e", F.lead("_r").over(neighbours.across(keys)))).where(c("_e").isNotNull())
    at = lambda s: tuple(c(s)[k] for k in "xyz")
    # Half the cross product of the diagonals is the sum of both triangles.
    area = cross(minus(at("_e"), at("_n")), minus(at("_d"), at("_r")))
    mean = {k: (c("_n")[k] + c("_r")[k] + c("_d")[k] + c("_e")[k]) / 4 for k in "xyz"}
    return d.withColumns({f"a{k}": q / 2 for k, q in zip("xyz", area, strict=True)} | mean).drop("_n", "_r", "_d", "_e")


def footprints(nodes: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, footprint.Corners]:
    """Map cells between nodes (``keys, row, col`` and their places ``y, x`` on the radar grid) with the corners of their footprints there, in order around."""
    d = nodes.withColumn("_n", F.struct("y", "x"))
    d = neighbours.blocked(d, 1, keys).withColumns({"_r": F.lead("_n").over(neighbours.along(keys)), "_d": F.lead("_n").over(neighbours.across(keys))})
    d = neighbours.owned(d.withColumn("_e", F.lead("_r").over(neighbours.across(keys)))).where(c("_e").isNotNull())
    return d, [(c(k)["y"], c(k)["x"]) for k in ("_n", "_r", "_e", "_d")]


def facet_amounts(cells: DataFrame, orbit: DataFrame, key: str = "orbit_id") -> DataFrame:
    """Facets with ``t, r`` of their centres, ``sigma`` (their area) and ``gamma`` (their area as seen from the platform; 0 if it faces away)."""
    d = geometry.ground_to_radar(cells, orbit, key, state=True)
    los = tuple(k / c("r") for k in minus(vector("p"), vector()))
    outward = F.when(dot(vector("a"), vector()) < 0, -1.0).otherwise(1.0)
    return d.withColumns({"sigma": norm(vector("a")), "gamma": F.greatest(outward * dot(vector("a"), los), F.lit(0.0))})


def area_layers(amounts: DataFrame, keys: tuple[str, ...], t0: float, prf: float, r0: float, spacing: float) -> DataFrame:
    """``keys, row, col, sigma, gamma``: facet areas dealt to the four radar cells around them and summed."""
    d = image_places(amounts, t0, prf, r0, spacing)
    return footprint.scatter(d, {"sigma": c("sigma"), "gamma": c("gamma")}, keys=keys)


def area_layers_by_overlap(amounts: DataFrame, corners: footprint.Corners, keys: tuple[str, ...]) -> DataFrame:
    """``keys, row, col, sigma, gamma``: each facet's areas dealt to the radar cells under its footprint, in the proportion of the overlaps, and summed; a footprint without area gives none."""
    whole = F.nullif(footprint.polygon_area(corners), F.lit(0.0))
    d = footprint.cell_shares(amounts.drop("row", "col"), corners).withColumn("_w", c("share") / whole)
    return d.where("_w IS NOT NULL AND share > 1e-9").groupBy(*keys, "row", "col").agg(*(F.sum(c("_w") * c(k)).alias(k) for k in ("sigma", "gamma")))


def normalisation() -> Column:
    """The factor from gamma to sigma of a radar cell, null without an area."""
    return c("gamma") / F.nullif(c("sigma"), F.lit(0.0))


def reflector_angles(u: Vector, tilt: Column, heading: Column) -> Vector:
    """A unit vector in east, north and up, turned to the axes of a corner reflector of that tilt and heading (clockwise from east)."""
    turn = heading + math.pi / 4
    x, y, z = F.cos(turn) * u[0] - F.sin(turn) * u[1], F.sin(turn) * u[0] + F.cos(turn) * u[1], u[2]
    # Back by the tilt about the axis (1, -1, 0).
    a, s, k = math.sqrt(0.5), F.sin(tilt), F.cos(tilt)
    inner = (x - y) * a
    return x * k + a * z * s + a * inner * (1 - k), y * k + a * z * s - a * inner * (1 - k), z * k - a * (x + y) * s


def rotated(q: list[Column], v: Vector, back: bool = False) -> Vector:
    """A vector turned by a unit quaternion (or back by its conjugate)."""
    w = q[0]
    u = tuple((-k if back else k) for k in q[1:])
    t = tuple(2 * k for k in cross(u, v))
    s = cross(u, t)
    return tuple(a + w * b + e for a, b, e in zip(v, t, s, strict=True))


def antenna_angles(points: DataFrame) -> DataFrame:
    """``points`` (``x, y, z``, ``px..pz`` and the antenna's ``q0..q3``) with ``el, az``: the angle from boresight, split by its direction."""
    look = minus(vector(), vector("p"))
    unit = tuple(k / norm(look) for k in look)
    d = points.withColumns({f"_u{k}": q for k, q in zip("xyz", rotated([c(f"q{i}") for i in range(4)], unit, True), strict=True)})
    off, way = F.acos(F.least(F.greatest(c("_uz"), F.lit(-1.0)), F.lit(1.0))), F.atan2("_uy", "_ux")
    return d.withColumns({"el": off * F.cos(way), "az": off * F.sin(way)}).drop("_ux", "_uy", "_uz")


def antenna_to_ground(points: DataFrame) -> DataFrame:
    """``points`` (``el, az``, ``px..pz``, ``q0..q3``, ``h``) with ``r, x, y, z``: where the direction meets the ellipsoid raised by h; null where it misses."""
    off, way = F.hypot("el", "az"), F.atan2("az", "el")
    local = F.sin(off) * F.cos(way), F.sin(off) * F.sin(way), F.cos(off)
    d = points.withColumns({f"_u{k}": q for k, q in zip("xyz", rotated([c(f"q{i}") for i in range(4)], local), strict=True)})
    big, small = geodesy.A + c("h"), geodesy.B + c("h")
    scaled = lambda v: (v[0] / big, v[1] / big, v[2] / small)
    p, u = scaled(vector("p")), scaled(vector("_u"))
    a, b, k = dot(u, u), dot(p, u), dot(p, p) - 1
    root = b * b - a * k
    d = d.withColumn("r", F.when(root >= 0, (-b - F.sqrt(root)) / a))
    return d.withColumns({n: q + c("r") * w for n, q, w in zip("xyz", vector("p"), vector("_u"), strict=True)}).drop("_ux", "_uy", "_uz")


def attitude_at(times: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """``times`` (``keys, t``) with ``q0..q3``, interpolated between the attitude states around t; times outside them go."""
    names = [f"q{i}" for i in range(4)]
    s = asof.segments(states.select(*keys, "t", *names), keys).select(*keys, "t", F.struct("t", *names, "next").alias("_s"))
    j = asof.asof(times, s, keys, ["_s"]).where(c("_s").isNotNull() & (c("t") <= c("_s.next.t")))
    q = asof.slerp([c("_s")[n] for n in names], [c("_s.next")[n] for n in names], (c("t") - c("_s.t")) / (c("_s.next.t") - c("_s.t")))
    return j.withColumns(dict(zip(names, q, strict=True))).drop("_s")


def attitude_doppler(points: DataFrame, wavelength: float) -> DataFrame:
    """``points`` (``px..vz``, ``q0..q3``, ``r, h, side``) with ``doppler``: of the antenna's plane of azimuth 0 at range r."""
    q = [c(f"q{i}") for i in range(4)]
    d = points.withColumns({f"_z{k}": v for k, v in zip("xyz", rotated(q, (F.lit(0.0), F.lit(0.0), F.lit(1.0))), strict=True)} | {f"_x{k}": v for k, v in zip("xyz", rotated(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0))), strict=True)})
    d = on_surface(d, vector("_z"), vector("_x"), c("side"))
    return d.withColumn("doppler", geometry.doppler(minus(vector(), vector("p")), vector("v"), wavelength)).drop(*(f"_{a}{k}" for a in "zx" for k in "xyz"))
