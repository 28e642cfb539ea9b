"""WGS84 geodesy and map projections as column expressions; angles in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A = 6378137.0
E2 = 0.0066943799901
B = A * math.sqrt(1 - E2)
_E = math.sqrt(E2)
Vector = tuple[Column, Column, Column]


def enu(lon: Column, lat: Column) -> tuple[Vector, Vector, Vector]:
    """East, north and up unit vectors."""
    so, co, sa, ca = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
    return (-so, co, F.lit(0.0)), (-sa * co, -sa * so, ca), (ca * co, ca * so, sa)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def r_east(lat: Column) -> Column:
    return A / F.sqrt(1 - E2 * F.sin(lat) ** 2)


def r_north(lat: Column) -> Column:
    return A * (1 - E2) / F.pow(1 - E2 * F.sin(lat) ** 2, F.lit(1.5))


def to_xyz(lon: Column, lat: Column, h: Column) -> Vector:
    r = r_east(lat)
    return (r + h) * F.cos(lat) * F.cos(lon), (r + h) * F.cos(lat) * F.sin(lon), (r * (1 - E2) + h) * F.sin(lat)


def to_llh(x: Column, y: Column, z: Column) -> Vector:
    """Longitude, latitude and height by the reduced latitude, improved once."""
    p = F.hypot(x, y)
    ep2 = E2 / (1 - E2)
    beta = F.atan2(z * A, p * B)
    for _ in range(2):
        lat = F.atan2(z + ep2 * B * F.sin(beta) ** 3, p - E2 * A * F.cos(beta) ** 3)
        beta = F.atan2(F.sin(lat) * (B / A), F.cos(lat))
    # The height holds at the poles too: along the normal, not over the cosine.
    return F.atan2(y, x), lat, p * F.cos(lat) + z * F.sin(lat) - A * F.sqrt(1 - E2 * F.sin(lat) ** 2)


def utm_zone(lon_degrees: Column) -> Column:
    return (F.floor((lon_degrees + 180) / 6) + 1).cast("int")


def epsg(lon: Column, lat: Column) -> Column:
    """Polar stereographic beyond 75 degrees, UTM below, geographic on the equator; degrees."""
    zone = utm_zone(lon)
    return F.when(lat >= 75, 3413).when(lat <= -75, 3031).when(lat > 0, 32600 + zone).when(lat < 0, 32700 + zone).otherwise(4326).cast("int")


_N = (A - B) / (A + B)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the third flattening: geographic to transverse Mercator and back.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)



def _conformal(lat: Column) -> Column:
    """Tangent of the conformal latitude."""
    s = F.sin(lat)
    return F.sinh(F.atanh(s) - _E * F.atanh(_E * s))


def _geographic(tau: Column) -> Column:
    """Latitude of a conformal tangent, by six fixed steps."""

    def step(t: Column, _: Column) -> Column:
        sigma = F.sinh(_E * F.atanh(_E * t / F.sqrt(1 + t * t)))
        ti = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
        return t + (tau - ti) / F.sqrt(1 + ti * ti) * (1 + (1 - E2) * t * t) / ((1 - E2) * F.sqrt(1 + t * t))

    return F.atan(F.aggregate(F.sequence(F.lit(1), F.lit(6)), tau, step))


def utm(lon: Column, lat: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """The series' angles are multiples of one: its sines and cosines come from the conformal tangent, the multiples by recurrence."""
    d = lon - F.radians((zone * 6 - 183).cast("double"))
    tau, cos = _conformal(lat), F.cos(d)
    size = tau * tau + cos * cos
    root = F.sqrt(size)
    sh = F.sin(d) / root
    s, k, hs, hk = 2 * tau * cos / size, (cos * cos - tau * tau) / size, 2 * sh * F.sqrt(1 + sh * sh), 1 + 2 * sh * sh
    x, y = F.asinh(sh), F.atan2(tau, cos)
    sn, kn, hsn, hkn = s, k, hs, hk
    for n, a in enumerate(_FORWARD):
        if n:
            sn, kn = sn * k + kn * s, kn * k - sn * s
            hsn, hkn = hsn * hk + hkn * hs, hkn * hk + hsn * hs
        x, y = x + a * kn * hsn, y + a * sn * hkn
    return 500000.0 + 0.9996 * _RECT * x, 0.9996 * _RECT * y + F.when(north, 0.0).otherwise(1e7)


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    eta, xi = (x - 500000.0) / (0.9996 * _RECT), (y - F.when(north, 0.0).otherwise(1e7)) / (0.9996 * _RECT)
    e, s = eta, xi
    for k, b in enumerate(_BACK, 1):
        e, s = e - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta), s - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    tau = F.sin(s) / F.sqrt(F.sinh(e) ** 2 + F.cos(s) ** 2)
    return F.atan2(F.sinh(e), F.cos(s)) + F.radians((zone * 6 - 183).cast("double")), _geographic(tau)


def _q(s: Column) -> Column:
    return (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(_E * s) / _E)


_K30 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
_QP = 1 + (1 - E2) * math.atanh(_E) / _E


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area, true at 30 degrees."""
    return A * _K30 * lon, A / (2 * _K30) * _q(F.sin(lat))


def equal_area_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    b = F.asin(2 * y * _K30 / (A * _QP))
    e4, e6 = E2**2, E2**3
    lat = b + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b) + 761 * e6 / 45360 * F.sin(6 * b)
    return x / (A * _K30), lat


def _t_at(lat: float) -> float:
    s = math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - _E * s) / (1 + _E * s)) ** (_E / 2)


def _polar_of(north: Column) -> tuple[Column, Column, Column]:
    """Sign, central meridian and scale of the two polar projections (70 N, 45 W; 71 S, 0)."""
    k = lambda deg: A * math.cos(math.radians(deg)) / math.sqrt(1 - E2 * math.sin(math.radians(deg)) ** 2) / _t_at(math.radians(deg))
    return F.when(north, 1.0).otherwise(-1.0), F.when(north, math.radians(-45)).otherwise(0.0), F.when(north, k(70)).otherwise(k(71))


def polar(lon: Column, lat: Column, north: Column) -> tuple[Column, Column]:
    sign, center, k = _polar_of(north)
    # exp of minus the isometric latitude: no tangent that is steep at the far pole.
    s = F.sin(sign * lat)
    rho = k * F.exp(-(F.atanh(s) - _E * F.atanh(_E * s)))
    d = sign * (lon - center)
    return sign * rho * F.sin(d), -sign * rho * F.cos(d)


def polar_inverse(x: Column, y: Column, north: Column) -> tuple[Column, Column]:
    sign, center, k = _polar_of(north)
    t = F.hypot(x, y) / k
    lat = sign * _geographic(F.sinh(-F.log(t)))
    lon = center + sign * F.atan2(sign * x, -sign * y)
    return F.pmod(lon + math.pi, F.lit(2 * math.pi)) - math.pi, lat


def effective_looks(lines: int, samples: int, range_spacing: Column, azimuth_spacing: Column, bandwidth: Column, azimuth_resolution: Column) -> Column:
    """Cells averaged, in units of resolution cells."""
    return lines * samples * range_spacing * azimuth_spacing / (299792458.0 / 2 / bandwidth * azimuth_resolution)


def poly1(x: Column, coefficients: list[float]) -> Column:
    """Horner's rule, the constant first."""
    out = F.lit(float(coefficients[-1]))
    for k in coefficients[-2::-1]:
        out = out * x + k
    return out


def poly2(y: Column, x: Column, rows: list[list[float]]) -> Column:
    """A polynomial in y whose coefficients are polynomials in x."""
    out = poly1(x, rows[-1])
    for r in rows[-2::-1]:
        out = out * y + poly1(x, r)
    return out
