"""Intervals, as-of joins, runs, sets, top rows, names and sources (J, W9 to W12, T, U, X, S)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from echogrid.operators import asof, grid, intervals
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6

c = F.col


@query("j3_differential_phase", "slc mask", ", a AS (SELECT row, col, re, im, m % 10 > 0 AS ok FROM slc JOIN mask USING (row, col)), t AS (SELECT a.row, a.col, a.re * b.re + a.im * b.im AS x, a.im * b.re - a.re * b.im AS y, a.ok AND b.ok AS ok FROM a JOIN a b ON b.row = a.row + 1 AND b.col = a.col) SELECT row, col, round(CASE WHEN ok THEN atan2(y, x) END, 6) + 0.0 AS phase FROM t")
def j3(spark, sf):
    from echogrid.functions import cplx

    a = rel.slc(spark, sf).join(rel.mask(spark, sf), ["row", "col"]).withColumn("ok", c("m") % 10 > 0).drop("m")
    b = a.select((c("row") - 1).alias("row"), "col", c("re").alias("bre"), c("im").alias("bim"), c("ok").alias("bok"))
    z = cplx.conj_mul(cplx.pair(), cplx.pair("b"))
    return a.join(b, ["row", "col"]).select("row", "col", r6(F.when(c("ok") & c("bok"), cplx.phase(z))).alias("phase"))


@query("j4_mask_overlay", "img mask", "SELECT row, col, round(CASE WHEN coalesce(m, 0) < 100 THEN v END, 6) + 0.0 AS v, coalesce(m, 0) AS m FROM img LEFT JOIN mask USING (row, col)")
def j4(spark, sf):
    m = rel.img(spark, sf).join(rel.mask(spark, sf), ["row", "col"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return m.select("row", "col", r6(F.when(c("m") < 100, c("v"))).alias("v"), "m")


_J5 = ", j AS (SELECT i.row, i.col, i.v, min(s) AS s FROM img i LEFT JOIN swath w ON i.row = w.row AND i.col >= w.start AND i.col < w.stop GROUP BY i.row, i.col, i.v)"


@query("j5_subswath", "img swath", f"{_J5} SELECT row, col, coalesce(s, 0) AS s FROM j")
def j5(spark, sf):
    return intervals.subswath(rel.img(spark, sf), rel.swath(spark, sf)).select("row", "col", "s")


@query("j5_subswath_defaults", "img", " SELECT row, col, 1 AS none, CASE WHEN col >= 10 AND col < 20 THEN 1 ELSE 2 END AS empty FROM img")
def j5_defaults(spark, sf):
    """No sub-swath at all, and a second one without intervals, which takes what the first leaves."""
    kind = "row long, s int, start int, stop int"
    x = intervals.subswath(rel.img(spark, sf), spark.createDataFrame([], kind)).withColumnRenamed("s", "none")
    first = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"), F.lit(1).alias("s"), F.lit(10).alias("start"), F.lit(20).alias("stop"))
    swaths = first.unionByName(spark.createDataFrame([(None, 2, None, None)], kind))
    return intervals.subswath(x, swaths).select("row", "col", "none", c("s").alias("empty"))


@query("j7_fill_gaps", "img swath", f"{_J5} SELECT row, col, round(CASE WHEN s IS NULL THEN -1.0 ELSE v END, 6) + 0.0 AS v FROM j")
def j7(spark, sf):
    return intervals.fill_gaps(rel.img(spark, sf), rel.swath(spark, sf), {"v": -1.0}).select("row", "col", r6(c("v")).alias("v"))


@query("j6_transmit_gaps", "", "WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events) SELECT a.event_id AS i, b.event_id AS j FROM p a JOIN p b ON a.user_id = b.user_id AND b.t >= a.t + 600000000 AND b.t <= a.t + 14400000000")
def j6(spark, sf):
    p = rel.read(spark, sf, "events").select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    w = p.select("user_id", c("event_id").alias("i"), (c("t") + 600000000).alias("start"), (c("t") + 14400000000).alias("stop"))
    return intervals.overlaps(w, p.select("user_id", c("event_id").alias("j"), "t"), ["user_id"], 7200000000.0).select("i", "j")


@query("j8_orbit_state", "", "WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t FROM events WHERE event_id % 4 = 0), o AS (SELECT user_id, t, 7000000 * cos(t / 100000) AS p, -70 * sin(t / 100000) AS v FROM s), g AS (SELECT *, lead(t) OVER w AS t1, lead(p) OVER w AS p1, lead(v) OVER w AS v1 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)), e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 - 1704067200.0 AS te FROM events WHERE event_id % 4 <> 0), j AS (SELECT e.event_id, (te - t) / (t1 - t) AS u, t1 - t AS h, p, v, p1, v1 FROM e ASOF JOIN g ON e.user_id = g.user_id AND e.te >= g.t WHERE t1 IS NOT NULL) SELECT event_id, round((2 * u * u * u - 3 * u * u + 1) * p + (u * u * u - 2 * u * u + u) * h * v + (3 * u * u - 2 * u * u * u) * p1 + (u * u * u - u * u) * h * v1, 3) + 0.0 AS p, round(((6 * u * u - 6 * u) * p + (6 * u - 6 * u * u) * p1) / h + (3 * u * u - 4 * u + 1) * v + (3 * u * u - 2 * u) * v1, 5) + 0.0 AS v FROM j")
def j8(spark, sf):
    t = (F.unix_micros(c("ts").cast("timestamp")) / 1000000.0 - 1704067200.0).alias("t")
    e = rel.read(spark, sf, "events").select("event_id", "user_id", t)
    o = e.where("event_id % 4 = 0").select("user_id", "t", (7000000 * F.cos(c("t") / 100000)).alias("p"), (-70 * F.sin(c("t") / 100000)).alias("v"))
    s = asof.segments(o, ["user_id"]).select("user_id", "t", F.struct("t", "p", "v", "next").alias("seg"))
    j = asof.asof(e.where("event_id % 4 <> 0"), s, ["user_id"], ["seg"]).where("seg IS NOT NULL")
    h = c("seg.next.t") - c("seg.t")
    p, v = asof.hermite((c("t") - c("seg.t")) / h, h, c("seg.p"), c("seg.v"), c("seg.next.p"), c("seg.next.v"))
    # After the last state of a series there is no segment: the as-of row must be the last segment's own.
    inside = c("t") < c("seg.next.t")
    return j.where(inside).select("event_id", (F.round(p, 3) + F.lit(0.0)).alias("p"), (F.round(v, 5) + F.lit(0.0)).alias("v"))


#: Each user's events number the states of an orbit, ten seconds apart (a little off for the Hermite polynomial); other events ask for it in between.
_ORBITS = lambda off, n, before: (
    f"WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), o AS (SELECT user_id, k, 10.0 * k + {off} * (k % 3) AS t FROM e), s AS (SELECT user_id, k, t, 7000000 * cos(t / 1000) AS p, -7000 * sin(t / 1000) AS v FROM o), "
    f"z AS (SELECT user_id, k, t, count(*) OVER (PARTITION BY user_id) AS n, max(t) OVER (PARTITION BY user_id) AS last FROM s), q AS (SELECT event_id, e.user_id, z.t + abs(value) % 9 AS t, least(greatest(e.k - {before}, 0), n - {n}) AS lo FROM e JOIN z ON z.user_id = e.user_id AND z.k = e.k WHERE n >= {n} AND z.t + abs(value) % 9 <= last), "
    f"a AS (SELECT event_id, s.k, q.t - s.t AS d, s.t, s.p, s.v FROM q JOIN s ON s.user_id = q.user_id AND s.k BETWEEN lo AND lo + {n - 1}), h AS (SELECT a.event_id, a.k, any_value(a.d) AS d, any_value(a.p) AS p, any_value(a.v) AS v, product(b.d / (a.t - b.t)) FILTER (b.k <> a.k) AS h, sum(1 / (a.t - b.t)) FILTER (b.k <> a.k) AS b, "
    "sum(1 / b.d) FILTER (b.k <> a.k) AS g FROM a JOIN a b USING (event_id) GROUP BY a.event_id, a.k)"
)
_NEAR = " WHERE event_id NOT IN (SELECT event_id FROM a WHERE d = 0)"


def _orbit_places(spark, sf, off, method):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = rel.read(spark, sf, "events").select("event_id", "user_id", "value", (F.row_number().over(w) - 1).alias("k"))
    e = e.withColumn("t", 10.0 * c("k") + off * (c("k") % 3))
    s = e.select("user_id", "t", (7000000 * F.cos(c("t") / 1000)).alias("p"), (-7000 * F.sin(c("t") / 1000)).alias("v"))
    asked = e.select("event_id", "user_id", (c("t") + F.abs("value") % 9).alias("t")).where(F.abs("value") % 9 != 0)
    d = asof.orbit_at(asked, s, ["user_id"], {"p": "v"}, method)
    return d.select("event_id", (F.round("p", 2) + F.lit(0.0)).alias("p"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("j8_orbit_hermite", "", f"{_ORBITS(0.4, 4, 1)} SELECT event_id, round(sum(h * h * ((1 - 2 * b * d) * p + d * v)), 2) + 0.0 AS p, round(sum(2 * h * h * g * ((1 - 2 * b * d) * p + d * v) + h * h * (v - 2 * b * p)), 4) + 0.0 AS v FROM h{_NEAR} GROUP BY event_id")
def j8_hermite(spark, sf):
    """Positions and velocities of four states around a time, one polynomial through both."""
    return _orbit_places(spark, sf, 0.4, "hermite")


@query("j8_orbit_legendre", "", f"{_ORBITS(0.0, 9, 4)} SELECT event_id, round(sum(h * p), 2) + 0.0 AS p, round(sum(h * v), 4) + 0.0 AS v FROM h{_NEAR} GROUP BY event_id")
def j8_legendre(spark, sf):
    """Nine states around a time, a polynomial through their positions and one through their velocities."""
    return _orbit_places(spark, sf, 0.0, "legendre")


@query("j9_attitude_slerp", "pulse", ", a AS (SELECT i, 0.001 * x AS w0, 0.02 * x AS w1, (i % 10) / 10.0 AS u FROM pulse), q AS (SELECT i, u, cos(w0) AS a0, sin(w0) AS a1, cos(w1) AS b0, sin(w1) AS b1 FROM a), d AS (SELECT *, CASE WHEN a0 * b0 + a1 * b1 < 0 THEN -1.0 ELSE 1.0 END AS s, acos(least(abs(a0 * b0 + a1 * b1), 1.0)) AS g, least(abs(a0 * b0 + a1 * b1), 1.0) AS k FROM q), w AS (SELECT *, CASE WHEN k > 0.9999999 THEN 1 - u ELSE sin((1 - u) * g) / sin(g) END AS wa, CASE WHEN k > 0.9999999 THEN u ELSE sin(u * g) / sin(g) END * s AS wb FROM d) SELECT i, round(wa * a0 + wb * b0, 6) + 0.0 AS q0, round(wa * a1 + wb * b1, 6) + 0.0 AS q1 FROM w")
def j9(spark, sf):
    p = rel.pulse(spark, sf).select("i", (0.001 * c("x")).alias("w0"), (0.02 * c("x")).alias("w1"), ((c("i") % 10) / 10.0).alias("u"))
    q = asof.slerp([F.cos("w0"), F.sin("w0")], [F.cos("w1"), F.sin("w1")], c("u"))
    return p.select("i", r6(q[0]).alias("q0"), r6(q[1]).alias("q1"))


@query("j9_attitude_bracketed", "", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t, value FROM events), s AS (SELECT user_id, t, 0.02 * value + 0.000001 * t AS w FROM e WHERE event_id % 4 = 0), g AS (SELECT *, lead(t) OVER o AS t1, lead(w) OVER o AS w1 FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t)), j AS (SELECT e.event_id, (e.t - g.t) / (t1 - g.t) AS u, cos(w) AS a0, sin(w) AS a1, cos(w1) AS b0, sin(w1) AS b1 FROM e ASOF JOIN g ON e.user_id = g.user_id AND e.t >= g.t WHERE t1 IS NOT NULL AND e.t <= t1 AND e.event_id % 4 <> 0), d AS (SELECT *, CASE WHEN a0 * b0 + a1 * b1 < 0 THEN -1.0 ELSE 1.0 END AS s, least(abs(a0 * b0 + a1 * b1), 1.0) AS k FROM j), x AS (SELECT *, CASE WHEN k > 0.9999999 THEN 1 - u ELSE sin((1 - u) * acos(k)) / sin(acos(k)) END AS wa, CASE WHEN k > 0.9999999 THEN u ELSE sin(u * acos(k)) / sin(acos(k)) END * s AS wb FROM d) SELECT event_id, round(wa * a0 + wb * b0, 6) + 0.0 AS q0, round(wa * a1 + wb * b1, 6) + 0.0 AS q1 FROM x")
def j9_bracketed(spark, sf):
    """Attitude at a time: the two states around it by one as-of sort, then the shorter way between them."""
    from echogrid.operators import mapping

    t = F.unix_micros(c("ts").cast("timestamp")) / 1000000.0 - 1704067200.0
    e = rel.read(spark, sf, "events").select("event_id", "user_id", t.alias("t"), "value")
    w = 0.02 * c("value") + 0.000001 * c("t")
    s = e.where("event_id % 4 = 0").select("user_id", "t", F.cos(w).alias("q0"), F.sin(w).alias("q1"), F.lit(0.0).alias("q2"), F.lit(0.0).alias("q3"))
    d = mapping.attitude_at(e.where("event_id % 4 <> 0").select("event_id", "user_id", "t"), s, ["user_id"])
    return d.select("event_id", r6(c("q0")).alias("q0"), r6(c("q1")).alias("q1"))


@query("j10_latest_survey", "survey", ", t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY survey_date DESC, event_id) AS n FROM survey WHERE survey_date <= TIMESTAMP '2024-01-15') SELECT id, event_id, validity FROM t WHERE n = 1 AND validity <> 0")
def j10(spark, sf):
    last = asof.latest_before(rel.survey(spark, sf), ["id"], "survey_date", F.lit("2024-01-15").cast("timestamp_ntz"), "event_id")
    return last.where("validity <> 0").select("id", "event_id", "validity")


@query("j19_decimate_axis", "img", ", s AS (SELECT row, k AS col FROM (SELECT DISTINCT row FROM img), range(0, 20) t(k)) SELECT s.row, CAST(s.col AS INT) AS col, round(coalesce(v, 0.0), 6) + 0.0 AS v FROM s LEFT JOIN img i ON i.row = s.row AND i.col = s.col * 4")
def j19(spark, sf):
    axis = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col")).withColumn("from", c("col") * 4)
    main = rel.img(spark, sf).select("row", c("col").alias("from"), "v")
    return axis.join(main, ["row", "from"], "left").select("row", "col", r6(F.coalesce("v", F.lit(0.0))).alias("v"))


@query("j20_linear_resample", "img", ", o AS (SELECT row, k AS col, least(greatest(k * 0.4 - 1.0, 0.0), 15.0) AS x FROM (SELECT DISTINCT row FROM img), range(0, 48) t(k)), f AS (SELECT *, least(floor(x), 14.0) AS k0 FROM o) SELECT f.row, CAST(f.col AS INT) AS col, round(a.v + (b.v - a.v) * (x - k0), 6) + 0.0 AS v FROM f JOIN img a ON a.row = f.row AND a.col = k0 JOIN img b ON b.row = f.row AND b.col = k0 + 1")
def j20(spark, sf):
    side = rel.img(spark, sf).where("col < 16").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"))
    out = side.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("x", F.least(F.greatest(c("col") * 0.4 - 1.0, F.lit(0.0)), F.lit(15.0)))
    k = F.least(F.floor("x"), F.lit(14)).cast("int")
    a, b = F.element_at("m", k), F.element_at("m", k + 1)
    return out.select("row", "col", r6(a + (b - a) * (c("x") - k)).alias("v"))


_BAND = "greatest(a.center - a.width / 2, b.center - b.width / 2) AS lo, least(a.center + a.width / 2, b.center + b.width / 2) AS hi"


@query("j21_channel_intersection", "channel", f", t AS (SELECT a.scene, a.pol, a.id, a.freq, b.id AS other, {_BAND} FROM channel a JOIN channel b ON a.scene = b.scene AND a.pol = b.pol WHERE a.freq = 'A' AND b.id <> a.id AND a.center - a.width / 2 <= b.center + b.width / 2 AND b.center - b.width / 2 <= a.center + a.width / 2) SELECT scene, pol, id, freq, other, (lo + hi) / 2 AS center, hi - lo AS width FROM t WHERE hi - lo > 0")
def j21(spark, sf):
    x = rel.channel(spark, sf)
    return intervals.channel_intersection(x.where("freq = 'A'"), x, ["scene"]).where("other <> id")


@query("j22_sample_decode", "slc", ", k AS (SELECT row, col, CAST(floor(re * 100) AS INT) AS a, CAST(floor(im * 100) AS INT) AS b FROM slc) SELECT row, col, round(sign(a + 0.5) * pow(abs(a + 0.5), 1.2), 6) + 0.0 AS re, round(sign(b + 0.5) * pow(abs(b + 0.5), 1.2), 6) + 0.0 AS im FROM k")
def j22(spark, sf):
    codes = rel.slc(spark, sf).select("row", "col", F.floor(c("re") * 100).cast("int").alias("a"), F.floor(c("im") * 100).cast("int").alias("b"))
    # The value table of an eight-bit code has 256 entries.
    lut = spark.range(-128, 128).select(c("id").cast("int").alias("code"), (F.signum(c("id") + 0.5) * F.pow(F.abs(c("id") + 0.5), F.lit(1.2))).alias("value"))
    one = lambda k, out: F.broadcast(lut.select(c("code").alias(k), c("value").alias(out)))
    return codes.join(one("a", "re"), "a").join(one("b", "im"), "b").select("row", "col", r6(c("re")).alias("re"), r6(c("im")).alias("im"))


@query("j23_point_in_polygon", "target", ", e AS (SELECT * FROM (VALUES (-100.0, -50.0, 120.0, -40.0), (120.0, -40.0, 90.0, 60.0), (90.0, 60.0, 0.0, 10.0), (0.0, 10.0, -110.0, 55.0), (-110.0, 55.0, -100.0, -50.0)) v(x1, y1, x2, y2)) SELECT id FROM target, e GROUP BY id HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1")
def j23(spark, sf):
    from echogrid.operators.grid import in_polygon

    corners = [(-100.0, -50.0), (120.0, -40.0), (90.0, 60.0), (0.0, 10.0), (-110.0, 55.0)]
    return rel.target(spark, sf).where(in_polygon(c("lon"), c("lat"), corners)).select("id")


@query("j24_coverage", "target", ", s AS (SELECT DISTINCT CAST(floor(lon / 2) AS INT) AS x, CAST(floor(lat / 2) AS INT) AS y FROM target), d AS (SELECT x, y FROM s WHERE (x + y) % 3 <> 0) SELECT count(*) AS cells, count(*) - count(d.x) AS missing, round((count(*) - count(d.x)) / count(*), 6) AS share FROM s LEFT JOIN d USING (x, y)")
def j24(spark, sf):
    s = rel.target(spark, sf).select(F.floor(c("lon") / 2).cast("int").alias("x"), F.floor(c("lat") / 2).cast("int").alias("y")).distinct()
    d = s.where((c("x") + c("y")) % 3 != 0).withColumn("ok", F.lit(1))
    g = s.join(d, ["x", "y"], "left").agg(F.count("*").alias("cells"), F.count_if(c("ok").isNull()).alias("missing"))
    return g.select("cells", "missing", F.round(c("missing") / c("cells"), 6).alias("share"))


@query("j25_raster_sum", "img", ", a AS (SELECT row, col, v FROM img WHERE (row + col) % 3 <> 0), b AS (SELECT row, col, v * 2 AS v FROM img WHERE (row + col) % 4 <> 0) SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, round(coalesce(a.v, 0.0) + coalesce(b.v, 0.0), 6) + 0.0 AS v FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col")
def j25(spark, sf):
    a = rel.img(spark, sf).where((c("row") + c("col")) % 3 != 0)
    b = rel.img(spark, sf).where((c("row") + c("col")) % 4 != 0).select("row", "col", (c("v") * 2).alias("w"))
    return a.join(b, ["row", "col"], "full").select("row", "col", r6(F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("v"))


@query("j26_cube_to_surface", "img", ", h AS (SELECT row, (row % 97) / 96.0 * 62.9 AS x FROM (SELECT DISTINCT row FROM img)) SELECT h.row, round(a.v + (b.v - a.v) * (x - floor(x)), 6) + 0.0 AS v FROM h JOIN img a ON a.row = h.row AND a.col = floor(x) JOIN img b ON b.row = h.row AND b.col = floor(x) + 1")
def j26(spark, sf):
    x = (c("row") % 97) / 96.0 * 62.9
    pairs = rel.img(spark, sf).withColumn("x", x).where((c("col") == F.floor("x")) | (c("col") == F.floor("x") + 1))
    g = pairs.groupBy("row", "x").agg(F.sum(c("v") * (1 - F.abs(c("x") - c("col")))).alias("v"))
    return g.select("row", r6(c("v")).alias("v"))


@query("j34_anomaly_bits", "img", ", i AS (SELECT * FROM (VALUES (-0.3, -0.1, 0), (-0.15, 0.05, 1), (0.02, 0.4, 2)) t(lo, hi, bit)) SELECT row, col, CAST(coalesce(bit_or(1 << bit), 0) AS INT) AS bits FROM img LEFT JOIN i ON v BETWEEN lo AND hi GROUP BY row, col")
def j34(spark, sf):
    listed = spark.createDataFrame([(-0.3, -0.1, 0), (-0.15, 0.05, 1), (0.02, 0.4, 2)], "low double, high double, bit int")
    return intervals.flagged(rel.img(spark, sf), listed, "v").select("row", "col", "bits")


_SERIES = "WITH s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"


@query("w10_change_points", "", f"{_SERIES} SELECT event_id, user_id FROM s WHERE b IS NULL OR b <> event_type")
def w10(spark, sf):
    return intervals.changes(rel.read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id")


@query("j35_timing_in_force", "", f"{_SERIES}, k AS (SELECT user_id, ts, event_id, value FROM s WHERE b IS NULL OR b <> event_type), l AS (SELECT user_id, ts, last(event_id ORDER BY event_id) AS setting FROM k GROUP BY user_id, ts) SELECT e.event_id, l.setting FROM events e ASOF JOIN l ON e.user_id = l.user_id AND e.ts >= l.ts")
def j35(spark, sf):
    e = rel.read(spark, sf, "events")
    k = intervals.changes(e, ["user_id"], ["ts", "event_id"], ["event_type"]).groupBy("user_id", "ts").agg(F.max("event_id").alias("setting"))
    return asof.asof(e.select("event_id", "user_id", "ts"), k, ["user_id"], ["setting"], "ts").select("event_id", "setting")


@query("w9_runs", "img", ", k AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS g FROM img WHERE v > 0) SELECT row, CAST(min(col) AS INT) AS first, CAST(max(col) AS INT) AS last FROM k GROUP BY row, g")
def w9(spark, sf):
    return intervals.runs(rel.img(spark, sf), ["row"], "col", c("v") > 0)


@query("w11_unwrap", "slc", f", p AS (SELECT row, col, atan2(im, re) AS p FROM slc), s AS (SELECT *, coalesce(-round_even((p - lag(p) OVER w) / {2 * math.pi}, 0), 0) AS k FROM p WINDOW w AS (PARTITION BY row ORDER BY col)) SELECT row, col, round(p + {2 * math.pi} * sum(k) OVER (PARTITION BY row ORDER BY col), 5) + 0.0 AS phase FROM s")
def w11(spark, sf):
    p = rel.slc(spark, sf).select("row", "col", F.atan2("im", "re").alias("p"))
    return asof.unwrapped(p, ["row"], "col", "p").select("row", "col", (F.round("unwrapped", 5) + F.lit(0.0)).alias("phase"))


@query("w12_block_jumps", "img", f", b AS (SELECT CAST(floor(row / 50) AS BIGINT) AS block, CAST(floor(col / 16) AS INT) AS part, median(v * 40) AS m FROM img GROUP BY 1, 2), d AS (SELECT *, coalesce(-round_even((m - lag(m) OVER w) / {2 * math.pi}, 0), 0) AS k FROM b WINDOW w AS (PARTITION BY block ORDER BY part)) SELECT block, part, CAST(sum(k) OVER (PARTITION BY block ORDER BY part) AS BIGINT) AS turns FROM d")
def w12(spark, sf):
    b = rel.img(spark, sf).groupBy(F.floor(c("row") / 50).alias("block"), F.floor(c("col") / 16).cast("int").alias("part")).agg(F.median(c("v") * 40).alias("m"))
    w = Window.partitionBy("block").orderBy("part")
    k = F.coalesce(-F.rint((c("m") - F.lag("m").over(w)) / (2 * math.pi)), F.lit(0.0))
    return b.withColumn("k", k).select("block", "part", F.sum("k").over(w).cast("long").alias("turns"))


@query("w18_uniform_resampling", "", "WITH p AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3600000000.0 AS t, value FROM events), k AS (SELECT user_id, t, value, unnest(generate_series(CAST(ceil((t - 6) / 4) AS BIGINT), CAST(floor((t + 6) / 4) AS BIGINT))) AS k FROM p), w AS (SELECT *, 1 - abs(k * 4 - t) / 6 AS w FROM k) SELECT user_id, k, round(sum(w * value) / sum(w), 6) AS value FROM w GROUP BY user_id, k HAVING sum(w) > 0.000001")
def w18(spark, sf):
    t = (F.unix_micros(c("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0
    p = rel.read(spark, sf, "events").select("user_id", t.alias("t"), "value")
    return asof.uniform(p, ["user_id"], 4.0, 6.0, ["value"]).select("user_id", "k", F.round("value", 6).alias("value"))


@query("w19_tone_removal", "slc", "SELECT row, col, round(re - avg(re) OVER w, 6) + 0.0 AS re, round(im - avg(im) OVER w, 6) + 0.0 AS im FROM slc WINDOW w AS (PARTITION BY floor(row / 100), col)")
def w19(spark, sf):
    w = Window.partitionBy(F.floor(c("row") / 100), "col")
    return rel.slc(spark, sf).select("row", "col", r6(c("re") - F.avg("re").over(w)).alias("re"), r6(c("im") - F.avg("im").over(w)).alias("im"))


@query("w20_zero_crossings", "img", ", t AS (SELECT row, col, v, lead(v) OVER (PARTITION BY row ORDER BY col) AS n FROM img) SELECT row, col, round(col + v / (v - n), 6) AS x FROM t WHERE v * n < 0")
def w20(spark, sf):
    w = Window.partitionBy("row").orderBy("col")
    t = rel.img(spark, sf).withColumn("n", F.lead("v").over(w)).where(c("v") * c("n") < 0)
    return t.select("row", "col", F.round(c("col") + c("v") / (c("v") - c("n")), 6).alias("x"))


@query("w20_half_power_width", "img", ", m AS (SELECT row, max(v * v) AS top FROM img GROUP BY row), p AS (SELECT row, min(col) AS peak FROM img JOIN m USING (row) WHERE v * v = top GROUP BY row), t AS (SELECT i.row, i.col, peak, v * v - top / 2 AS d, lead(v * v - top / 2) OVER (PARTITION BY i.row ORDER BY col) AS n FROM img i JOIN m USING (row) JOIN p USING (row)), x AS (SELECT row, peak, col, col + d / (d - n) AS x FROM t WHERE (d >= 0) <> (n >= 0)) SELECT row, round(min(x) FILTER (col >= peak) - max(x) FILTER (col < peak), 6) AS width FROM x GROUP BY row")
def w20_width(spark, sf):
    """Width at half power: between the crossings on either side of the peak; null if one is missing."""
    line = Window.partitionBy("row")
    p = c("v") * c("v")
    t = rel.img(spark, sf).withColumn("p", p).withColumn("top", F.max("p").over(line))
    t = t.withColumn("peak", F.min(F.when(c("p") == c("top"), c("col"))).over(line)).withColumn("d", c("p") - c("top") / 2)
    t = t.withColumn("n", F.lead("d").over(line.orderBy("col"))).where((c("d") >= 0) != (c("n") >= 0)).withColumn("x", c("col") + c("d") / (c("d") - c("n")))
    right, left = F.min(F.when(c("col") >= c("peak"), c("x"))), F.max(F.when(c("col") < c("peak"), c("x")))
    return t.groupBy("row").agg(F.round(right - left, 6).alias("width"))


@query("w21_layover_shadow", "img", ", t AS (SELECT row, col, v, col + v * 6 AS x FROM img), s AS (SELECT *, max(v) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, max(x) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far, min(x) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS near FROM t) SELECT row, col, CAST(CASE WHEN v <= top - 0.3 THEN 1 ELSE 0 END | CASE WHEN x <= far OR x >= near THEN 2 ELSE 0 END AS INT) AS code FROM s")
def w21(spark, sf):
    from echogrid.operators.neighbours import layover_shadow

    t = rel.img(spark, sf).withColumns({"x": c("col") + c("v") * 6, "e": c("v") + 0.3})
    return layover_shadow(t, ["row"], "col", "v", "x", slack=0.3).select("row", "col", "code")


@query("w24_tec_gradient", "pulse", ", t AS (SELECT i, t, x * 0.7 AS s, floor(t / 86400) AS day FROM pulse), n AS (SELECT i, t, s, lead(t) OVER w AS t1, lead(s) OVER w AS s1 FROM t WINDOW w AS (PARTITION BY day ORDER BY t, i)) SELECT i, round(s1 - s, 6) + 0.0 AS step, round((t + t1) / 2 - 1704067200, 3) AS mid FROM n WHERE t1 IS NOT NULL")
def w24(spark, sf):
    p = rel.pulse(spark, sf).withColumns({"s": c("x") * 0.7, "day": F.floor(c("t") / 86400)})
    w = Window.partitionBy("day").orderBy("t", "i")
    n = p.withColumns({"t1": F.lead("t").over(w), "s1": F.lead("s").over(w)}).where("t1 IS NOT NULL")
    return n.select("i", r6(c("s1") - c("s")).alias("step"), F.round((c("t") + c("t1")) / 2 - 1704067200, 3).alias("mid"))


@query("a40_pass_direction", "", "WITH s AS (SELECT user_id, ts, event_id, value - 40 > 0 AS u FROM events), l AS (SELECT *, lag(u) OVER (PARTITION BY user_id ORDER BY ts) <> u AS ch FROM s) SELECT user_id, CASE WHEN 2 * count_if(u) > count(*) THEN 'ascending' ELSE 'descending' END AS direction, CAST(coalesce(sum(CAST(ch AS INT)), 0) AS BIGINT) AS changes FROM l GROUP BY user_id")
def a40(spark, sf):
    s = rel.read(spark, sf, "events").select("user_id", c("ts").alias("t"), (c("value") - 40).alias("vz"))
    return asof.pass_direction(s, ["user_id"])


@query("t1_arg_max", "img", ", t AS (SELECT CAST(floor(row / 16) AS BIGINT) AS a, CAST(floor(col / 16) AS BIGINT) AS b, row, col, v FROM img), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY v DESC, row, col) AS n FROM t) SELECT a, b, row, col FROM k WHERE n = 1")
def t1(spark, sf):
    best = F.max(F.struct("v", (-c("row")).alias("r"), (-c("col")).alias("k")))
    g = rel.img(spark, sf).groupBy(F.floor(c("row") / 16).alias("a"), F.floor(c("col") / 16).alias("b")).agg(best.alias("t"))
    return g.select("a", "b", (-c("t.r")).alias("row"), (-c("t.k")).alias("col"))


@query("t3_largest_component", "", "WITH k AS (SELECT vec_id % 20 AS scene, label, count(*) AS n FROM embeddings WHERE label > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY n DESC, label) AS o FROM k) SELECT scene, label, n FROM r WHERE o = 1")
def t3(spark, sf):
    k = rel.read(spark, sf, "embeddings").where("label > 0").groupBy((c("vec_id") % 20).alias("scene"), "label").agg(F.count("*").alias("n"))
    best = k.groupBy("scene").agg(F.max(F.struct("n", (-c("label")).alias("l"))).alias("t"))
    return best.select("scene", (-c("t.l")).alias("label"), c("t.n").alias("n"))


@query("t4_interval_eigenvalues", "slc", ", b AS (SELECT CAST(floor(a.row / 2) AS BIGINT) AS k, avg(a.re * a.re + a.im * a.im) AS p, avg(b.re * b.re + b.im * b.im) AS q, avg(a.re * b.re + a.im * b.im) AS x, avg(a.im * b.re - a.re * b.im) AS y FROM slc a JOIN slc b ON b.row = a.row + 1 AND b.col = a.col WHERE a.row % 2 = 0 GROUP BY 1) SELECT k, round((p + q) / 2 + sqrt(pow((p - q) / 2, 2) + x * x + y * y), 6) AS first, round((p + q) / 2 - sqrt(pow((p - q) / 2, 2) + x * x + y * y), 6) + 0.0 AS second FROM b")
def t4_eigen(spark, sf):
    """Eigenvalues of the covariance of each interval of lines, the largest first (of two lines here, so that SQL can state them)."""
    from echogrid.operators import lines

    e = lines.eigenvalues(lines.to_lines(rel.slc(spark, sf), ["row"]), 2).where(F.size("values") == 2)
    return e.select("k", r6(F.get("values", F.lit(0))).alias("first"), r6(F.get("values", F.lit(1))).alias("second"))


@query("t4_sorted_values", "img", "SELECT row, round(list_sort(list(v), 'DESC')[1], 6) + 0.0 AS first, round(list_sort(list(v), 'DESC')[64], 6) + 0.0 AS last, round(list_sort(list(v), 'DESC')[8], 6) + 0.0 AS eighth FROM img GROUP BY row")
def t4(spark, sf):
    e = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"), F.sort_array("embedding", asc=False).alias("s"))
    at = lambda k: r6(F.get("s", F.lit(k)).cast("double"))
    return e.select("row", at(0).alias("first"), at(63).alias("last"), at(7).alias("eighth"))


@query("t5_k_nearest", "target", ", p AS (SELECT a.id, b.id AS other, pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) AS d FROM target a JOIN target b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS n FROM p) SELECT id, other, CAST(n AS INT) AS n FROM r WHERE n <= 3")
def t5(spark, sf):
    return grid.k_nearest(rel.target(spark, sf), 3, 4.0, "lat", "lon").select("id", "other", "n")


@query("u1_regularised_channels", "channel", ", g AS (SELECT scene, freq, count(DISTINCT (center, width)) AS n, count(*) AS pols, max(center - width / 2) AS lo, min(center + width / 2) AS hi FROM channel GROUP BY scene, freq) SELECT scene, freq, n, pols, CASE WHEN hi > lo THEN (lo + hi) / 2 END AS center, CASE WHEN hi > lo THEN hi - lo END AS width FROM g")
def u1(spark, sf):
    half = c("width") / 2
    g = rel.channel(spark, sf).groupBy("scene", "freq").agg(F.countDistinct("center", "width").alias("n"), F.count("*").alias("pols"), F.max(c("center") - half).alias("lo"), F.min(c("center") + half).alias("hi"))
    ok = c("hi") > c("lo")
    return g.select("scene", "freq", "n", "pols", F.when(ok, (c("lo") + c("hi")) / 2).alias("center"), F.when(ok, c("hi") - c("lo")).alias("width"))


@query("u2_total_grid", "", "WITH a AS (SELECT user_id % 5 AS scene, ts, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id % 5, ts, value FROM events WHERE event_type = 'error') SELECT scene, min(ts) AS first, max(ts) AS last, min(value) AS low, max(value) AS high, count(*) AS n FROM a GROUP BY scene")
def u2(spark, sf):
    e = rel.read(spark, sf, "events").select((c("user_id") % 5).alias("scene"), "ts", "value", "event_type")
    a = e.where("event_type = 'click'").unionByName(e.where("event_type = 'error'"))
    return a.groupBy("scene").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("u3_distinct_intervals", "swath", "SELECT DISTINCT s, start, stop FROM swath")
def u3(spark, sf):
    return rel.swath(spark, sf).select("s", "start", "stop").distinct()


@query("u4_common_polarisations", "channel", "SELECT scene, pol FROM channel WHERE freq = 'A' AND width > 10 INTERSECT SELECT scene, pol FROM channel WHERE center > 1210")
def u4(spark, sf):
    x = rel.channel(spark, sf)
    return x.where("freq = 'A' AND width > 10").select("scene", "pol").intersect(x.where("center > 1210").select("scene", "pol"))


@query("x1_granule_ids", "survey", ", t AS (SELECT event_id, 'L2_' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || '_' || CASE WHEN validity % 2 = 0 THEN 'A' ELSE 'D' END || '_' || strftime(survey_date, '%Y%m%dT%H%M%S') AS g FROM survey) SELECT event_id, g, CAST(regexp_extract(g, '^L(\\d)_(\\d{3})_([AD])_(\\d{8}T\\d{6})$', 2) AS INT) AS track, regexp_extract(g, '^L(\\d)_(\\d{3})_([AD])_(\\d{8}T\\d{6})$', 4) AS start FROM t")
def x1(spark, sf):
    from echogrid.functions.names import granule_id, granule_parts

    g = rel.survey(spark, sf).select("event_id", granule_id(2, c("id") % 1000, c("validity") % 2 == 0, c("survey_date")).alias("g"))
    parts = granule_parts(c("g"))
    return g.select("event_id", "g", parts["track"].alias("track"), parts["start"].alias("start"))


@query("x2_iso_seconds", "survey", ", t AS (SELECT event_id, strftime(survey_date, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(event_id % 1000000000 AS VARCHAR), 9, '0') AS s FROM survey) SELECT event_id, round(epoch(strptime(s[1:19], '%Y-%m-%dT%H:%M:%S')) - 1704067200 + CAST('0' || s[20:] AS DOUBLE), 6) AS seconds FROM t")
def x2(spark, sf):
    from echogrid.functions.names import iso_seconds

    s = rel.survey(spark, sf).select("event_id", F.concat(F.date_format("survey_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((c("event_id") % 1000000000).cast("string"), 9, "0")).alias("s"))
    return s.select("event_id", F.round(iso_seconds(c("s"), 1704067200), 6).alias("seconds"))


@query("s1_raster_window", "img", "SELECT row, col, round(v, 6) + 0.0 AS v FROM img WHERE row BETWEEN 20 AND 60 AND col BETWEEN 8 AND 24")
def s1(spark, sf):
    from echogrid.sources import rasters

    lines = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"), c("embedding").cast("array<double>").alias("v"))
    return rasters.window(lines, ["v"], (20, 60), (8, 24)).select("row", "col", r6(c("v")).alias("v"))


@query("s2_line_scan", "", "SELECT vec_id AS row, len(embedding) AS n, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 6) + 0.0 AS total FROM embeddings")
def s2(spark, sf):
    lines = rel.read(spark, sf, "embeddings").select(c("vec_id").alias("row"), c("embedding").cast("array<double>").alias("v"))
    return lines.select("row", F.size("v").cast("long").alias("n"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("s4_band_stack", "img", "SELECT row, col, round(v, 6) + 0.0 AS b1, round(v * 2, 6) + 0.0 AS b2 FROM img")
def s4(spark, sf):
    from echogrid.sources import rasters

    a = rel.img(spark, sf)
    return rasters.wide(rasters.stack([a, a.withColumn("v", c("v") * 2)]), 2).select("row", "col", r6(c("b1")).alias("b1"), r6(c("b2")).alias("b2"))


@query("s10_channel_subset", "channel", "SELECT id, freq, pol FROM channel WHERE (freq = 'A' AND pol IN (0, 2)) OR (freq = 'B' AND pol IN (1))")
def s10(spark, sf):
    from echogrid.sources import rasters

    return rasters.channels(rel.channel(spark, sf), {"A": [0, 2], "B": [1]}).select("id", "freq", "pol")


@query("s11_copy_cast", "slc", "SELECT row, col, CAST(re * 1000 AS FLOAT) AS re, CAST(im * 1000 AS FLOAT) AS im FROM slc")
def s11(spark, sf):
    return rel.slc(spark, sf).select("row", "col", (c("re") * 1000).cast("float").alias("re"), (c("im") * 1000).cast("float").alias("im"))
