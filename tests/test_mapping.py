"""Geometry on the ellipsoid, angles, nearest points, bridges and area layers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import geodesy
from echogrid.operators import components, geometry, grid, looks, mapping


def xyz(lon, lat, h):
    n = geodesy.A / np.sqrt(1 - geodesy.E2 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - geodesy.E2) + h) * np.sin(lat)], -1)


def height(x):
    """Height over the ellipsoid by many rounds of the latitude."""
    p, lat = np.hypot(x[..., 0], x[..., 1]), np.arctan2(x[..., 2], np.hypot(x[..., 0], x[..., 1]))
    for _ in range(50):
        n = geodesy.A / np.sqrt(1 - geodesy.E2 * np.sin(lat) ** 2)
        lat = np.arctan2(x[..., 2] + geodesy.E2 * n * np.sin(lat), p)
    return p * np.cos(lat) + x[..., 2] * np.sin(lat) - geodesy.A * np.sqrt(1 - geodesy.E2 * np.sin(lat) ** 2)


def test_ground_places_meet_range_doppler_and_height(spark):
    rng = np.random.default_rng(2)
    n = 60
    lon, lat = rng.uniform(-np.pi, np.pi, n), rng.uniform(-1.4, 1.4, n)
    p = xyz(lon, lat, rng.uniform(5e5, 8e5, n))
    up = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)
    v = np.cross(up, rng.normal(size=(n, 3)))
    v = 7500 * v / np.linalg.norm(v, axis=1, keepdims=True) + 20 * up
    r, h, side = rng.uniform(8.5e5, 1e6, n), rng.uniform(-100, 5000, n), rng.choice([-1, 1], n)
    rows = [(k, *map(float, p[k]), *map(float, v[k]), float(r[k]), float(h[k]), int(side[k])) for k in range(n)]
    d = spark.createDataFrame(rows, "id long, px double, py double, pz double, vx double, vy double, vz double, r double, h double, side int")
    out = {q.id: (q.x, q.y, q.z) for q in mapping.radar_to_ground(d).collect()}
    x = np.array([out[k] for k in range(n)])
    assert np.allclose(np.linalg.norm(x - p, axis=1), r, atol=1e-4)
    assert np.abs(((x - p) * v).sum(axis=1) / 7500).max() < 1e-3
    assert np.abs(height(x) - h).max() < 0.01
    # Left of the track is where up times velocity points.
    assert (np.sign((np.cross(up, v) * (x - p)).sum(axis=1)) == side).all()


def test_crossings_give_back_ground_places(spark):
    """Map points to the radar grid and back to the ellipsoid at their heights."""
    rows = [(k, 0, float(np.radians(10 + k * 0.03)), float(np.radians(45 + k * 0.01)), 30.0 * k) for k in range(40)]
    m = spark.createDataFrame(rows, "id long, orbit_id int, lon double, lat double, h double")
    p0, v = xyz(np.radians(5.5), np.radians(44.5), 7e5), 7500 * np.array([-np.sin(np.radians(44.5)) * np.cos(np.radians(5.5)), -np.sin(np.radians(44.5)) * np.sin(np.radians(5.5)), np.cos(np.radians(44.5))])
    orbit = geometry.straight_orbits(spark, m.select("orbit_id").distinct(), 10, 10.0, tuple(F.lit(float(a - 45 * b)) for a, b in zip(p0, v, strict=True)), tuple(map(float, v)))
    d = mapping.layers(m, orbit).withColumnsRenamed({"lon": "lon0", "lat": "lat0", "x": "x0", "y": "y0", "z": "z0"}).withColumn("side", F.lit(-1))
    back = mapping.radar_to_ground(d).select(F.max(F.abs(F.col("lon") - F.col("lon0"))), F.max(F.abs(F.col("lat") - F.col("lat0")))).first()
    assert max(back) < 1e-8


def test_reflector_axes(spark):
    d = spark.range(1)
    east = d.select(*mapping.reflector_angles((F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0), F.lit(0.0))).first()
    assert np.allclose(east, [np.sqrt(0.5), np.sqrt(0.5), 0])
    # A reflector that faces south-east by 0.3 sees what lies there in its plane of symmetry.
    ahead = d.select(*mapping.reflector_angles((F.lit(float(np.cos(0.3))), F.lit(float(-np.sin(0.3))), F.lit(0.0)), F.lit(0.2), F.lit(0.3))).first()
    assert ahead[0] == pytest.approx(ahead[1]) and np.linalg.norm(ahead) == pytest.approx(1) and ahead[2] == pytest.approx(-np.sin(0.2))


def test_quaternions_turn_like_matrices(spark):
    rng = np.random.default_rng(4)
    q, v = rng.normal(size=4), rng.normal(size=3)
    q /= np.linalg.norm(q)
    w, x, y, z = q
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    lit = lambda a: [F.lit(float(k)) for k in a]
    assert np.allclose(spark.range(1).select(*mapping.rotated(lit(q), tuple(lit(v)))).first(), m @ v)
    assert np.allclose(spark.range(1).select(*mapping.rotated(lit(q), tuple(lit(v)), True)).first(), m.T @ v)


def test_nearest_points_are_those_of_all(spark):
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(size=(120, 2)) * 0.1, rng.uniform(-50, 50, (30, 2)), [[0.0, 0.0], [0.0, 0.0], [400.0, 400.0]]])
    d = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(p)], "id long, y double, x double")
    got = {}
    for r in grid.k_nearest(d, 4, 0.05).collect():
        got.setdefault(r.id, {})[r.n] = r.other
    d2 = ((p[:, None] - p[None]) ** 2).sum(-1)
    for k in range(len(p)):
        order = sorted((x for x in range(len(p)) if x != k), key=lambda x: (d2[k, x], x))[:4]
        assert [got[k][n] for n in (1, 2, 3, 4)] == order
    few = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id long, y double, x double")
    assert sorted((r.id, r.other) for r in grid.k_nearest(few, 3, 1.0).collect()) == [(1, 2), (2, 1)]
    assert grid.k_nearest(few.limit(0), 3, 1.0).count() == 0


def test_bridges_reach_every_component(spark):
    rows = [(0, 0, 1), (0, 1, 1), (0, 6, 2), (0, 50, 3), (0, 51, 3), (200, 51, 4)]
    labels = spark.createDataFrame(rows, "row long, col long, label long")
    got = sorted((r.a, r.b, r.d2) for r in components.bridges(labels, 6).collect())
    assert got == [(1, 2, 25.0), (2, 3, 44.0**2), (3, 4, 200.0**2)]
    assert components.bridges(labels.where("label = 1"), 6).count() == 0


def test_coherence_of_one_look_is_one(spark):
    from echogrid.functions import cplx

    d = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0)], "re double, im double, bre double, bim double")
    assert d.agg(looks.coherence(cplx.pair(), cplx.pair("b"), 1).alias("c")).first().c == 1.0


def test_facets_sum_to_the_area_of_the_ground(spark):
    """A flat patch: the facets' areas are the ellipsoid's, and what each radar cell gets sums to all of it."""
    rows = [(i, j, 0, float(np.radians(10 + j * 0.01)), float(np.radians(45 + i * 0.01)), 0.0) for i in range(70) for j in range(12)]
    nodes = spark.createDataFrame(rows, "row long, col int, orbit_id int, lon double, lat double, h double")
    f = mapping.facets(nodes)
    area = f.agg(F.sum(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2))).first()[0]
    lat = np.radians(45.345)
    sides = geodesy.A * (1 - geodesy.E2) / (1 - geodesy.E2 * np.sin(lat) ** 2) ** 1.5 * np.radians(0.69), geodesy.A / np.sqrt(1 - geodesy.E2 * np.sin(lat) ** 2) * np.cos(lat) * np.radians(0.11)
    assert f.count() == 69 * 11 and area == pytest.approx(sides[0] * sides[1], rel=1e-4)
    scattered = mapping.footprint.scatter(f.withColumns({"y": F.col("row") * 0.3 + 0.1, "x": F.col("col") * 0.7}), {"area": F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)})
    assert scattered.agg(F.sum("area")).first()[0] == pytest.approx(area)


def test_dispersive_phase_of_a_shifted_pair(spark):
    """An image and its copy turned by a constant: the sub-band phases are equal, so the dispersive part is their fixed share."""
    from echogrid.operators.pipelines import dispersive_phase

    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, 32)) + 1j * rng.normal(size=(40, 32))
    w = z * np.exp(-0.4j)
    frame = lambda a: spark.createDataFrame([(i, j, float(x.real), float(x.imag)) for (i, j), x in np.ndenumerate(a)], "row long, col int, re double, im double")
    f0, fl, fh = 1257.5, 1237.5, 1277.5
    out = dispersive_phase(frame(z), frame(w), (f0, fl, fh), (5, 4), 0.5, 4, [0.25, 0.5, 0.25]).collect()
    expected = fl * fh / (f0 * (fh**2 - fl**2)) * (0.4 * fh - 0.4 * fl)
    assert len(out) == 32 and all(r.phase == pytest.approx(expected, abs=1e-6) for r in out)
