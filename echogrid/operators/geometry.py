"""Radar geometry over orbits and targets.

An orbit is one row per ``orbit_id`` with ``states``, its state vectors in order of time as
structs of ``t, px, py, pz, vx, vy, vz`` (a fixed few). Targets join it by the id; the segment
in which a target is passed is found within the array, and the crossing by fixed steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from echogrid.functions.geodesy import Vector, cross, dot, minus, norm
from echogrid.shared import shuffled, spread

#: Newton steps from the linear estimate; they double the digits.
STEPS = 5


def orbits(states: DataFrame, key: str = "orbit_id") -> DataFrame:
    """One row per orbit from a table of state vectors."""
    return states.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "px", "py", "pz", "vx", "vy", "vz"))).alias("states"))


def straight_orbits(spark: SparkSession, ids: DataFrame, n: int, step: float, start: Vector, velocity: tuple[float, float, float], first: float = 0.0) -> DataFrame:
    """Orbits of constant velocity whose places at time 0 are columns of ``ids``: for analytic checks. ``first``: the time of the first state."""
    t = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * step + first)
    state = lambda x: F.struct(x.alias("t"), *((p + v * x).alias(f"p{a}") for a, p, v in zip("xyz", start, velocity, strict=True)), *(F.lit(v).alias(f"v{a}") for a, v in zip("xyz", velocity, strict=True)))
    return ids.select("orbit_id", F.transform(t, state).alias("states"))


def _vector(s: Column, kind: str) -> Vector:
    return s[f"{kind}x"], s[f"{kind}y"], s[f"{kind}z"]


@F.pandas_udf(DoubleType())
def _crossing(g: pd.DataFrame) -> pd.Series:
    """Newton steps of ``ground_to_radar``, a batch of points at a time: as columns they make one method too long to be compiled."""
    v = g.to_numpy(float, na_value=np.nan).T
    u, x = v[0], v[1:4]
    k0, k1, k2, k3 = (v[4 + 3 * n : 7 + 3 * n] for n in range(4))
    for _ in range(STEPS):
        los, d = x - (((k3 * u + k2) * u + k1) * u + k0), (3 * k3 * u + 2 * k2) * u + k1
        u = np.clip(u - (los * d).sum(axis=0) / ((los * (6 * k3 * u + 2 * k2)).sum(axis=0) - (d * d).sum(axis=0)), 0.0, 1.0)
    return pd.Series(u)


def ground_to_radar(targets: DataFrame, orbit: DataFrame, key: str = "orbit_id", state: bool = False) -> DataFrame:
    """``targets`` (``key, x, y, z``) with ``t, r``: zero-Doppler time and slant range; null where the orbit never passes them.

    ``state``: with ``px..vz`` too, the platform at that time.

    The segment is the first in which the product of line of sight and velocity turns from
    positive to not positive. Its Hermite polynomials are worked out once, then the crossing is
    found by a fixed number of Newton steps from the segment's linear estimate.
    """
    x = F.col("x"), F.col("y"), F.col("z")
    j = targets.join(orbit.select(key, "states"), key)
    ahead = lambda s: dot(minus(x, _vector(s, "p")), _vector(s, "v"))
    pairs = F.arrays_zip(F.slice("states", F.lit(1), F.size("states") - 1).alias("a"), F.slice("states", F.lit(2), F.size("states") - 1).alias("b"))
    j = j.withColumn("_s", F.get(F.filter(pairs, lambda s: (ahead(s["a"]) > 0) & (ahead(s["b"]) <= 0)), F.lit(0))).drop("states")
    a, b = F.col("_s.a"), F.col("_s.b")
    h = b["t"] - a["t"]
    parts = {"_h": h, "_t": a["t"], "_u": ahead(a) / (ahead(a) - ahead(b))}
    for k in "xyz":
        p0, p1, v0, v1 = a[f"p{k}"], b[f"p{k}"], a[f"v{k}"] * h, b[f"v{k}"] * h
        parts |= {f"_{k}0": p0, f"_{k}1": v0, f"_{k}2": 3 * (p1 - p0) - 2 * v0 - v1, f"_{k}3": 2 * (p0 - p1) + v0 + v1}
    j = j.withColumns(parts).drop("_s")
    c = lambda k, n: F.col(f"_{k}{n}")
    place = lambda u: tuple(((c(k, 3) * u + c(k, 2)) * u + c(k, 1)) * u + c(k, 0) for k in "xyz")
    slope = lambda u: tuple((3 * c(k, 3) * u + 2 * c(k, 2)) * u + c(k, 1) for k in "xyz")
    given = F.struct("_u", *(q.cast("double").alias(f"p{k}") for k, q in zip("xyz", x, strict=True)), *(c(k, n) for n in range(4) for k in "xyz"))
    j = j.withColumn("_f", _crossing(given))
    u, own = F.col("_f"), {}
    if state:
        own = {f"p{k}": q for k, q in zip("xyz", place(u), strict=True)} | {f"v{k}": q / F.col("_h") for k, q in zip("xyz", slope(u), strict=True)}
    j = j.withColumns({"t": F.col("_t") + u * F.col("_h"), "r": norm(minus(x, place(u)))} | own)
    return j.drop("_f", *parts)


def radar_to_ground(points: DataFrame, radius: float, side: int = 1) -> DataFrame:
    """``points`` (``px..vz, r, h``) with ``x, y, z`` on the sphere of radius plus h, at zero Doppler, left (1) or right (-1).

    The place lies in the plane through the platform at right angles to the velocity: along it
    at the angle at which the distance to the centre is the wanted one.
    """
    p, v = (F.col("px"), F.col("py"), F.col("pz")), (F.col("vx"), F.col("vy"), F.col("vz"))
    speed = norm(v)
    d = points.withColumns({f"_t{k}": c / speed for k, c in zip("xyz", v, strict=True)})
    t = F.col("_tx"), F.col("_ty"), F.col("_tz")
    along = dot(p, t)
    # Nadir within the plane, and the cross direction to the left of the velocity.
    d = d.withColumns({f"_n{k}": along * b - a for k, a, b in zip("xyz", p, t, strict=True)})
    n = F.col("_nx"), F.col("_ny"), F.col("_nz")
    d = d.withColumn("_d", norm(n))
    u = tuple(k / F.col("_d") for k in n)
    c = cross(u, t)
    cosine = (dot(p, p) + F.col("r") ** 2 - (radius + F.col("h")) ** 2) / (2 * F.col("_d") * F.col("r"))
    sine = side * F.sqrt(F.greatest(1 - cosine**2, F.lit(0.0)))
    out = {k: a + F.col("r") * (cosine * b + sine * e) for k, a, b, e in zip("xyz", p, u, c, strict=True)}
    return d.withColumns(out).drop(*(f"_{a}{k}" for a in "tn" for k in "xyz"), "_d")


def back_project(cells: DataFrame, pulses: DataFrame, keys: list[str], spacing: float, wavelength: float, salt: int = 8) -> DataFrame:
    """``keys, id, re, im, n``: coherent sum over the pulses of each cell's aperture.

    ``cells``: ``keys, id, first, last, x, y, z`` (the pulse numbers of the aperture);
    ``pulses``: ``keys, k, px, py, pz, r0, re, im`` with arrays of range samples. A cell is dealt
    to the blocks of pulses that it needs, so a group is a block, salted by pulse; the samples
    are read by linear interpolation in range and turned by the two-way phase.
    """
    block = lambda c: F.floor(F.col(c) / salt)
    a = spread(cells, *keys, "id").withColumn("_b", F.explode(F.sequence(block("first"), block("last"))))
    b = pulses.withColumn("_b", block("k"))
    d = norm(minus((F.col("x"), F.col("y"), F.col("z")), (F.col("px"), F.col("py"), F.col("pz"))))
    j = a.join(shuffled(b), [*keys, "_b"]).where(F.col("k").between(F.col("first"), F.col("last"))).withColumn("_d", d)
    j = j.withColumn("_s", (F.col("_d") - F.col("r0")) / spacing).withColumn("_k", F.floor("_s").cast("int"))
    part = lambda v: F.get(v, F.col("_k")) * (1 - (F.col("_s") - F.col("_k"))) + F.get(v, F.col("_k") + 1) * (F.col("_s") - F.col("_k"))
    j = j.where((F.col("_k") >= 0) & (F.col("_k") + 1 < F.size("re"))).withColumns({"_re": part("re"), "_im": part("im"), "_p": F.col("_d") * (4 * math.pi / wavelength)})
    re, im = F.col("_re") * F.cos("_p") - F.col("_im") * F.sin("_p"), F.col("_re") * F.sin("_p") + F.col("_im") * F.cos("_p")
    return j.groupBy(*keys, "id").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.count("*").alias("n"))


def doppler(look: Vector, velocity: Vector, wavelength: float) -> Column:
    """Doppler frequency of a line of sight."""
    return 2 / wavelength * dot(velocity, look) / norm(look)


def dry_troposphere_delay(cosine: Column, h: Column) -> Column:
    """Two-way delay of dry air: 2.3 m at the zenith of sea level, a scale height of 6 km (fixed values), at the cosine of the incidence."""
    return 2 * 2.3 * F.exp(-h / 6000.0) / (299792458.0 * cosine)


def bistatic_delay(p: Vector, v: Vector, x: Vector) -> Column:
    """Two-way delay to x of a platform that moves on between transmission and reception."""
    c = 299792458.0
    d = minus(x, p)
    vv = dot(v, v)
    return 2 * (c * norm(d) - dot(d, v)) / (c * c - vv)


def baselines(reference: Vector, velocity: Vector, secondary: Vector, target: Vector) -> tuple[Column, Column]:
    """Parallel and perpendicular baseline; what lies along the track is taken off, the sign is that of the side."""
    speed = norm(velocity)
    t = tuple(k / speed for k in velocity)
    b = minus(secondary, reference)
    along = dot(b, t)
    b = tuple(x - along * y for x, y in zip(b, t, strict=True))
    look = minus(target, reference)
    size = norm(look)
    unit = tuple(k / size for k in look)
    parallel = dot(b, unit)
    side = cross(unit, t)
    return parallel, F.sqrt(F.greatest(dot(b, b) - parallel * parallel, F.lit(0.0))) * F.when(dot(b, side) < 0, -1.0).otherwise(1.0)


def aperture_seconds(r: Column, ground_speed: Column, wavelength: float, resolution: float) -> Column:
    """Duration of the synthetic aperture that gives an azimuth resolution, for small angles."""
    return wavelength / (2 * resolution) * r / ground_speed


def between(first: tuple, second: tuple, share: Column) -> Vector:
    """East, north and up displacements at a share of the way between two epochs."""
    return tuple(F.lit(a) + share * (F.lit(b) - F.lit(a)) for a, b in zip(first, second, strict=True))


def displacement(enu: Vector, basis: tuple[Vector, Vector, Vector], look: Vector, velocity: Vector) -> tuple[Column, Column]:
    """A displacement in east, north and up along the (unit) line of sight and along the track."""
    d = tuple(sum((k * b[i] for k, b in zip(enu, basis, strict=True)), F.lit(0.0)) for i in range(3))
    return dot(d, look), dot(d, velocity) / norm(velocity)


def apertures(cells: DataFrame, pulse: Column, r: Column, ratio: Column, spacing: float, wavelength: float, resolution: float) -> DataFrame:
    """``cells`` with ``first, last``: the pulses of each cell's synthetic aperture, around the pulse at its crossing.

    Its length is ``wavelength * r * ratio / (2 * resolution)``, with ``ratio`` the platform's
    distance to the centre over the cell's; ends are rounded outwards and kept from going below 0.
    """
    half = wavelength * r * ratio / (2 * resolution) / spacing / 2
    return cells.withColumns({"first": F.greatest(F.floor(pulse - half), F.lit(0)).cast("long"), "last": F.greatest(F.ceil(pulse + half), F.lit(0)).cast("long")})


def corner_spacing(targets: DataFrame, orbit: DataFrame, half: float, keys: list[str]) -> DataFrame:
    """``keys, dt, dr``: least half extent in time and range of the boxes of ``half`` metres around the targets (in y and z)."""
    ends = F.array(F.lit(-half), F.lit(half))
    corners = spread(targets, *keys, "id").withColumn("_y", F.explode(ends)).withColumn("_z", F.explode(ends)).withColumns({"y": F.col("y") + F.col("_y"), "z": F.col("z") + F.col("_z")})
    t = ground_to_radar(corners, orbit)
    each = t.groupBy(*keys, "id").agg(((F.max("t") - F.min("t")) / 2).alias("dt"), ((F.max("r") - F.min("r")) / 2).alias("dr"))
    return each.groupBy(*keys).agg(F.min("dt").alias("dt"), F.min("dr").alias("dr"))
