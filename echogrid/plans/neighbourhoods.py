"""Neighbourhood operators and interpolation (W, J11 to J18, T2)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from echogrid.operators import grid, neighbours
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6

c = F.col
K3, K5 = [0.25, 0.5, 0.25], [0.1, 0.2, 0.4, 0.2, 0.1]
_PI2 = 2 * math.pi


def _sum(x: str, kernel, axis: str) -> str:
    half = len(kernel) // 2
    part = "PARTITION BY row ORDER BY col" if axis == "col" else "PARTITION BY col ORDER BY row"
    return " + ".join(f"{k} * coalesce(lead({x}, {j - half}) OVER ({part}), 0)" for j, k in enumerate(kernel))


@query("w1_convolution", "img", f", a AS (SELECT row, col, {_sum('v', K5, 'col')} AS v FROM img) SELECT row, col, round(({_sum('v', K3, 'row')}) / {sum(K3) * sum(K5)}, 6) + 0.0 AS v FROM a")
def w1(spark, sf):
    return neighbours.smooth(rel.img(spark, sf), ["v"], K3, K5).select("row", "col", r6(c("v")).alias("v"))


_W2 = f", m AS (SELECT row, col, v, CASE WHEN (row * 7 + col) % 5 < 2 THEN 0.0 ELSE 1.0 END AS w FROM img), a AS (SELECT row, col, v, w, {_sum('v * w', K5, 'col')} AS n, {_sum('w', K5, 'col')} AS d FROM m), b AS (SELECT row, col, v, w, {_sum('n', K3, 'row')} AS n, {_sum('d', K3, 'row')} AS d FROM a), f AS (SELECT row, col, CASE WHEN w = 0 THEN v WHEN d = 0 THEN 0.0 ELSE n / d END AS v FROM b)"


def _masked(spark, sf):
    x = rel.img(spark, sf)
    return neighbours.smooth(x, ["v"], K3, K5, F.when((c("row") * 7 + c("col")) % 5 < 2, 0.0).otherwise(1.0))


@query("w2_masked_convolution", "img", f"{_W2} SELECT row, col, round(v, 6) + 0.0 AS v FROM f")
def w2(spark, sf):
    return _masked(spark, sf).select("row", "col", r6(c("v")).alias("v"))


@query("w3_low_pass_decimate", "img", f"{_W2} SELECT CAST(floor((row - 1) / 3) AS BIGINT) AS row, CAST(floor((col - 2) / 4) AS BIGINT) AS col, round(v, 6) + 0.0 AS v FROM f WHERE row >= 1 AND col >= 2 AND (row - 1) % 3 = 0 AND (col - 2) % 4 = 0")
def w3(spark, sf):
    f = _masked(spark, sf).where((c("row") >= 1) & (c("col") >= 2) & ((c("row") - 1) % 3 == 0) & ((c("col") - 2) % 4 == 0))
    return f.select(F.floor((c("row") - 1) / 3).alias("row"), F.floor((c("col") - 2) / 4).alias("col"), r6(c("v")).alias("v"))


_SQ = lambda k: [a * a for a in k]


@query("w4_smooth_with_sigma", "img", f", m AS (SELECT row, col, v, 1 / pow(0.1 + abs(v), 2) AS w FROM img), a AS (SELECT row, col, {_sum('v * w', K5, 'col')} AS x, {_sum('w', K5, 'col')} AS w, {_sum('w', _SQ(K5), 'col')} AS s FROM m), b AS (SELECT row, col, {_sum('x', K3, 'row')} AS x, {_sum('w', K3, 'row')} AS w, {_sum('s', _SQ(K3), 'row')} AS s FROM a) SELECT row, col, round(x / w, 6) + 0.0 AS v, round(sqrt(s) / w, 6) + 0.0 AS sigma FROM b")
def w4(spark, sf):
    x = rel.img(spark, sf).withColumn("sigma", 0.1 + F.abs("v"))
    return neighbours.smooth_with_sigma(x, "v", "sigma", K3, K5).select("row", "col", r6(c("v")).alias("v"), r6(c("sigma")).alias("sigma"))


_HOLES = ", h AS (SELECT row, col, CASE WHEN (row * 3 + col * 5) % 7 > 1 THEN v END AS v FROM img)"
_N3 = ", n AS (SELECT a.row, a.col, a.v, b.v AS w FROM h a, range(-1, 2) i(i), range(-1, 2) j(j), h b WHERE b.row = a.row + i AND b.col = a.col + j)"


def _holes(spark, sf):
    return rel.img(spark, sf).withColumn("v", F.when((c("row") * 3 + c("col") * 5) % 7 > 1, c("v")))


@query("w5_median_deviation", "img", f"{_HOLES}{_N3}, m AS (SELECT row, col, median(w) AS m FROM n GROUP BY row, col) SELECT row, col, round(any_value(m), 6) + 0.0 AS median, round(median(abs(w - m)), 6) + 0.0 AS mad FROM n JOIN m USING (row, col) GROUP BY row, col")
def w5(spark, sf):
    return neighbours.deviation(_holes(spark, sf), "v", 1, 1).select("row", "col", r6(c("median")).alias("median"), r6(c("mad")).alias("mad"))


@query("w6_outlier_mask", "img", f"{_HOLES}{_N3}, m AS (SELECT row, col, median(w) AS m FROM n GROUP BY row, col) SELECT row, col FROM h JOIN m USING (row, col) WHERE abs(v - m) > 0.15")
def w6(spark, sf):
    return neighbours.median(_holes(spark, sf), "v", 1, 1).where(F.abs(c("v") - c("median")) > 0.15).select("row", "col")


@query("w7_missing_neighbours", "img", f"{_HOLES}{_N3}, k AS (SELECT row, col, count_if(w IS NULL) AS k FROM n GROUP BY row, col) SELECT row, col, round(CASE WHEN k <= 2 THEN v END, 6) + 0.0 AS v, CAST(k AS BIGINT) AS missing FROM h JOIN k USING (row, col)")
def w7(spark, sf):
    d = neighbours.count_near(_holes(spark, sf), c("v").isNull(), 1, 1, "missing")
    return d.select("row", "col", r6(F.when(c("missing") <= 2, c("v"))).alias("v"), "missing")


@query("w8_fill_mean", "img", f"{_HOLES}{_N3}, f AS (SELECT row, col, coalesce(any_value(v), avg(w)) AS v FROM n GROUP BY row, col) SELECT row, col, round(v, 6) + 0.0 AS v FROM f")
def w8(spark, sf):
    return neighbours.fill_mean(_holes(spark, sf), "v", 1, 1).select("row", "col", r6(c("v")).alias("v"))


_COARSE = ", h AS (SELECT row, col, CASE WHEN row % 20 >= 14 AND col % 16 >= 9 THEN NULL ELSE v END AS v, CASE WHEN row % 20 BETWEEN 15 AND 18 AND col % 32 >= 24 THEN NULL WHEN (row + col) % 2 = 0 THEN v * 2 END AS a, CASE WHEN col % 32 BETWEEN 26 AND 29 THEN NULL ELSE v * 3 END AS b FROM img)"
_FROM = lambda t, x, u: f", {u} AS (SELECT d.row, d.col, coalesce(any_value(d.v), avg(o.{x})) AS v FROM {t} d, range(-1, 2) i(i), range(-1, 2) j(j) LEFT JOIN {'h' if x != 'v' else t} o ON o.row = d.row + i AND o.col = d.col + j GROUP BY d.row, d.col)"


@query("w8_pyramid_fill", "img", f"{_COARSE}{_FROM('h', 'a', 'p0')}{_FROM('p0', 'b', 'p1')}" + "".join(_FROM(f"p{k}", "v", f"p{k + 1}") for k in range(1, 5)) + " SELECT row, col, round(v, 5) + 0.0 AS v FROM p5")
def w8_pyramid(spark, sf):
    """Holes wider than a window: filled from two coarser layers with holes of their own, then inward from their edges."""
    y, x = c("row") % 20, c("col") % 16
    coarse = F.when(~(y.between(15, 18) & (c("col") % 32 >= 24)) & ((c("row") + c("col")) % 2 == 0), c("v") * 2)
    d = rel.img(spark, sf).select("row", "col", F.when(~((y >= 14) & (x >= 9)), c("v")).alias("v"), coarse.alias("a"), F.when(~(c("col") % 32).between(26, 29), c("v") * 3).alias("b"))
    return neighbours.fill_pyramid(d, "v", ["a", "b"], 1, 1).select("row", "col", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("w13_repair_turns", "img", f", h AS (SELECT row, col, v + {_PI2} * CAST((row * 5 + col * 3) % 11 = 0 AS INT) AS v FROM img){_N3}, m AS (SELECT row, col, median(w) AS m FROM n GROUP BY row, col) SELECT row, col, round(v - {_PI2} * round_even((v - m) / {_PI2}, 0), 6) + 0.0 AS v FROM h JOIN m USING (row, col)")
def w13(spark, sf):
    x = rel.img(spark, sf).withColumn("v", c("v") + _PI2 * ((c("row") * 5 + c("col") * 3) % 11 == 0).cast("int"))
    return neighbours.repair_turns(x, "v", 1, 1, 1).select("row", "col", r6(c("v")).alias("v"))


_TURNED = f", h AS (SELECT row, col, CASE WHEN (row + col * 3) % 13 = 0 THEN 0.0 ELSE v + {_PI2} * CAST(row % 9 IN (2, 3) AND col % 11 IN (4, 5) AS INT) END AS v FROM img), t0 AS (SELECT row, col, nullif(v, 0) AS x FROM h)"
_TURN = lambda k: f", n{k} AS (SELECT row, col, x, {_sum('coalesce(x, 0)', K5, 'col')} AS n, {_sum('CAST(x IS NOT NULL AS INT)', K5, 'col')} AS d FROM t{k}), s{k} AS (SELECT row, col, x, {_sum('n', K5, 'row')} AS n, {_sum('d', K5, 'row')} AS d FROM n{k}), t{k + 1} AS (SELECT row, col, x - {_PI2} * round_even((x - n / nullif(d, 0)) / {_PI2}, 0) AS x FROM s{k})"


@query("w13_repair_smoothed", "img", f"{_TURNED}{_TURN(0)}{_TURN(1)} SELECT row, col, round(coalesce(x, v), 6) + 0.0 AS v FROM t2 JOIN h USING (row, col)")
def w13_smoothed(spark, sf):
    """Patches that are a turn off, brought back to the smoothed surface in two rounds; holes stay."""
    turned = c("v") + _PI2 * ((c("row") % 9).isin(2, 3) & (c("col") % 11).isin(4, 5)).cast("int")
    x = rel.img(spark, sf).withColumn("v", F.when((c("row") + c("col") * 3) % 13 == 0, 0.0).otherwise(turned))
    return neighbours.repair_turns_smoothed(x, "v", K5, K5, 2).select("row", "col", r6(c("v")).alias("v"))


@query("w14_residues", "slc", f", p AS (SELECT row, col, atan2(im, re) AS p FROM slc), t AS (SELECT a.row, a.col, a.p AS p00, r.p AS p01, b.p AS p10, d.p AS p11 FROM p a LEFT JOIN p r ON r.row = a.row AND r.col = a.col + 1 LEFT JOIN p b ON b.row = a.row + 1 AND b.col = a.col LEFT JOIN p d ON d.row = a.row + 1 AND d.col = a.col + 1) SELECT row, col, CAST(coalesce(round((p10 - p00) / {_PI2}) + round((p11 - p10) / {_PI2}) + round((p01 - p11) / {_PI2}) + round((p00 - p01) / {_PI2}), 0) AS INT) AS charge FROM t")
def w14(spark, sf):
    p = rel.slc(spark, sf).select("row", "col", F.atan2("im", "re").alias("p"))
    return neighbours.residues(p, "p").select("row", "col", "charge")


@query("w15_phase_gradient", "slc", f", g AS (SELECT row, col, " + ", ".join(f"coalesce(re * lag(re) OVER {w} + im * lag(im) OVER {w}, 0) AS {n}re, coalesce(im * lag(re) OVER {w} - re * lag(im) OVER {w}, 0) AS {n}im" for n, w in (("x", "a"), ("y", "d"))) + f" FROM slc WINDOW a AS (PARTITION BY row ORDER BY col), d AS (PARTITION BY col ORDER BY row)), s AS (SELECT row, col, " + ", ".join(f"{_sum(k, K3, 'col')} AS {k}" for k in ("xre", "xim", "yre", "yim")) + " FROM g), t AS (SELECT row, col, " + ", ".join(f"{_sum(k, K3, 'row')} AS {k}" for k in ("xre", "xim", "yre", "yim")) + " FROM s) SELECT row, col, round(atan2(xim, xre), 5) + 0.0 AS gx, round(atan2(yim, yre), 5) + 0.0 AS gy FROM t")
def w15(spark, sf):
    r5 = lambda x: F.round(x, 5) + F.lit(0.0)
    return neighbours.phase_gradient(rel.slc(spark, sf), K3, K3).select("row", "col", r5(c("gx")).alias("gx"), r5(c("gy")).alias("gy"))


@query("w16_supported_convolution", "img", f"{_HOLES}, a AS (SELECT row, col, v, {_sum('coalesce(v, 0)', K3, 'col')} AS n, {_sum('CAST(v IS NOT NULL AS INT)', K3, 'col')} AS d FROM h), b AS (SELECT row, col, v, {_sum('n', K3, 'row')} AS n, {_sum('d', K3, 'row')} AS d FROM a) SELECT row, col, round(CASE WHEN v IS NULL THEN NULL WHEN d >= 0.5 THEN n / d END, 6) + 0.0 AS v FROM b")
def w16(spark, sf):
    h = _holes(spark, sf)
    ok = c("v").isNotNull().cast("double")
    support = neighbours.smooth(h.withColumn("k", ok), ["k"], K3, K3).select("row", "col", "k")
    s = neighbours.smooth(h, ["v"], K3, K3, ok).join(support, ["row", "col"])
    return s.select("row", "col", r6(F.when(c("k") >= 0.5, c("v"))).alias("v"))


@query("w17_line_interpolation", "img", f"{_HOLES}, e AS (SELECT row, col, v, last(CASE WHEN v IS NOT NULL THEN col END IGNORE NULLS) OVER b AS c0, last(v IGNORE NULLS) OVER b AS v0, first(CASE WHEN v IS NOT NULL THEN col END IGNORE NULLS) OVER a AS c1, first(v IGNORE NULLS) OVER a AS v1 FROM h WINDOW b AS (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY row ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT row, col, round(coalesce(v, v0 + (v1 - v0) * (col - c0) / (c1 - c0), v0, v1), 6) + 0.0 AS v FROM e")
def w17(spark, sf):
    return neighbours.fill_lines(_holes(spark, sf), "v").select("row", "col", r6(c("v")).alias("v"))


@query("w22_erosion", "img", ", h AS (SELECT row, col, v FROM img)" + _N3 + " SELECT row, col FROM n GROUP BY row, col HAVING count_if(w > -0.15) = 9")
def w22(spark, sf):
    return neighbours.eroded(rel.img(spark, sf), c("v") > -0.15, 1, 1).where("eroded").select("row", "col")


def _cross(x: str, op: str) -> str:
    return f" {op} ".join([x, *(f"coalesce(lag({x}, {k}) OVER {w}, FALSE)" for k in (1, -1) for w in ("a", "d"))])


_AD = "WINDOW a AS (PARTITION BY row ORDER BY col), d AS (PARTITION BY col ORDER BY row)"


@query("w23_opening", "img", f", f AS (SELECT row, col, v > -0.12 AS f FROM img), e AS (SELECT row, col, {_cross('f', 'AND')} AS e FROM f {_AD}), o AS (SELECT row, col, {_cross('e', 'OR')} AS o FROM e {_AD}) SELECT row, col FROM o WHERE o")
def w23(spark, sf):
    return neighbours.opened(rel.img(spark, sf), c("v") > -0.12).where("opened").select("row", "col")


@query("t2_sub_sample_peak", "img", ", k AS (SELECT row, col, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM img WINDOW w AS (PARTITION BY row ORDER BY col)), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY v DESC, col) AS n FROM k) SELECT row, col, round(col + (a - b) / nullif(2 * (a - 2 * v + b), 0), 6) AS x FROM r WHERE n = 1")
def t2(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("row").orderBy("col")
    k = rel.img(spark, sf).withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w)})
    best = k.groupBy("row").agg(F.max(F.struct("v", (-c("col")).alias("k"), "a", "b")).alias("t")).select("row", "t.*")
    return best.select("row", (-c("k")).alias("col"), F.round(-c("k") + neighbours.quadratic_peak(c("a"), c("v"), c("b")), 6).alias("x"))


_POINTS = ", p AS (SELECT id, CASE WHEN id % 50 = 0 THEN -3.0 ELSE abs(lat) * 2.1 END AS y, (lon + 180) * 0.17 AS x FROM target), q AS (SELECT id, least(greatest(y, 0.0), 199.0) AS y, least(greatest(x, 0.0), 63.0) AS x FROM p)"


def _points(spark, sf):
    y = F.when(c("id") % 50 == 0, -3.0).otherwise(F.abs("lat") * 2.1)
    return rel.target(spark, sf).select("id", y.alias("y"), ((c("lon") + 180) * 0.17).alias("x"))


@query("j11_lut_lookup", "img target", f"{_POINTS}, n AS (SELECT id, count(*) AS need, count(v) AS got, sum((1 - abs(y - row)) * (1 - abs(x - col)) * v) AS v FROM (SELECT q.*, floor(y) + r AS row, floor(x) + k AS col, v FROM q, range(0, 2) a(r), range(0, 2) b(k) LEFT JOIN img ON img.row = floor(y) + r AND img.col = floor(x) + k) t WHERE (1 - abs(y - row)) * (1 - abs(x - col)) <> 0 GROUP BY id) SELECT id, round(CASE WHEN need = got THEN v END, 6) + 0.0 AS v FROM n")
def j11(spark, sf):
    return grid.interpolate(_points(spark, sf), rel.img(spark, sf), [], clamp=(200, 64)).select("id", r6(c("v")).alias("v"))


_CUBIC = "CASE WHEN abs({0}) <= 1 THEN 1.5 * pow(abs({0}), 3) - 2.5 * pow(abs({0}), 2) + 1 WHEN abs({0}) < 2 THEN -0.5 * pow(abs({0}), 3) + 2.5 * pow(abs({0}), 2) - 4 * abs({0}) + 2 ELSE 0 END"


@query("j12_bicubic", "img target", f"{_POINTS}, t AS (SELECT p.id, ({_CUBIC.format('(y - (floor(y) + r))')}) * ({_CUBIC.format('(x - (floor(x) + k))')}) AS w, v FROM p, range(-1, 3) a(r), range(-1, 3) b(k) LEFT JOIN img ON img.row = floor(y) + r AND img.col = floor(x) + k), n AS (SELECT id, count(*) AS need, count(v) AS got, sum(w * v) AS v FROM t WHERE w <> 0 GROUP BY id) SELECT id, round(CASE WHEN need = got THEN v END, 6) + 0.0 AS v FROM n")
def j12(spark, sf):
    return grid.interpolate(_points(spark, sf), rel.img(spark, sf), [], "bicubic").select("id", r6(c("v")).alias("v"))


#: The weight of each node of the spline's window at share u of the interval, as SQL.
_SPLINE = lambda u, k: "CASE " + k + " " + " ".join(f"WHEN {n - grid.INSIDE} THEN {a!r} + {u} * ({b!r} + {u} * ({d!r} + {u} * {e!r}))" for n, (a, b, d, e) in enumerate(grid.spline_weights().tolist())) + " END"


@query("j12_biquintic", "img target", f"{_POINTS}, t AS (SELECT p.id, ({_SPLINE('(y - floor(y))', 'r')}) * ({_SPLINE('(x - floor(x))', 'k')}) AS w, v FROM p, range(-1, 5) a(r), range(-1, 5) b(k) LEFT JOIN img ON img.row = floor(y) + r AND img.col = floor(x) + k), n AS (SELECT id, count(*) AS need, count(v) AS got, sum(w * v) AS v FROM t WHERE w <> 0 GROUP BY id) SELECT id, round(CASE WHEN need = got THEN v END, 6) + 0.0 AS v FROM n")
def j12_biquintic(spark, sf):
    """A natural cubic spline through six cells along each axis, solved once for all windows."""
    return grid.interpolate(_points(spark, sf), rel.img(spark, sf), [], "biquintic").select("id", r6(c("v")).alias("v"))


@query("j12_nearest", "img target", f"{_POINTS} SELECT id, round(v, 6) + 0.0 AS v FROM p LEFT JOIN img ON img.row = floor(y + 0.5) AND img.col = floor(x + 0.5)")
def j12n(spark, sf):
    return grid.interpolate(_points(spark, sf), rel.img(spark, sf), [], "nearest").select("id", r6(c("v")).alias("v"))


@query("j13_dem_height", "img target", ", p AS (SELECT id, (lat + 80) * 2.9 AS y, ((lon + 540) - 360 * floor((lon + 540) / 360)) * 0.17 AS x FROM target), n AS (SELECT id, y, count(*) AS need, count(v) AS got, sum((1 - abs(y - (floor(y) + r))) * (1 - abs(x - (floor(x) + k))) * v) AS v FROM p, range(0, 2) a(r), range(0, 2) b(k) LEFT JOIN img ON img.row = floor(y) + r AND img.col = floor(x) + k WHERE (1 - abs(y - (floor(y) + r))) * (1 - abs(x - (floor(x) + k))) <> 0 GROUP BY id, y) SELECT id, round(coalesce(CASE WHEN need = got AND floor(y) >= 2 AND floor(y) < 399 THEN v END, -17.0), 6) + 0.0 AS h FROM n")
def j13(spark, sf):
    p = rel.target(spark, sf).select("id", ((c("lat") + 80) * 2.9).alias("y"), (F.pmod(c("lon") + 540, F.lit(360.0)) * 0.17).alias("x"))
    d = grid.interpolate(p, rel.img(spark, sf), [])
    inside = (F.floor("y") >= 2) & (F.floor("y") < 399)
    return d.select("id", r6(F.coalesce(F.when(inside, c("v")), F.lit(-17.0))).alias("h"))


@query("j14_regrid", "img", ", p AS (SELECT row, col, row * 0.83 + 1.3 AS y, col * 0.71 + 0.4 AS x FROM img), t AS (SELECT p.row, p.col, (1 - abs(y - (floor(y) + r))) * (1 - abs(x - (floor(x) + k))) AS w, i.v FROM p, range(0, 2) a(r), range(0, 2) b(k) LEFT JOIN img i ON i.row = floor(y) + r AND i.col = floor(x) + k), n AS (SELECT row, col, count(*) AS need, count(v) AS got, sum(w * v) AS v FROM t WHERE w <> 0 GROUP BY row, col) SELECT row, col, round(CASE WHEN need = got THEN v END, 6) + 0.0 AS v FROM n")
def j14(spark, sf):
    p = rel.img(spark, sf).select(c("row").alias("r0"), c("col").alias("c0"), (c("row") * 0.83 + 1.3).alias("y"), (c("col") * 0.71 + 0.4).alias("x"))
    return grid.interpolate(p, rel.img(spark, sf), []).select(c("r0").alias("row"), c("c0").alias("col"), r6(c("v")).alias("v"))


_BIG = ", h AS (SELECT row, col, CASE WHEN floor(row / 3) % 4 = 1 AND floor(col / 3) % 3 = 1 THEN NULL ELSE v END AS v FROM img), d AS (SELECT a.row, a.col, pow(a.row - b.row, 2) + pow(a.col - b.col, 2) AS d2, b.row AS r, b.col AS c, b.v FROM (SELECT row, col FROM h WHERE v IS NULL) a, range(-4, 5) i(i), range(-4, 5) j(j), h b WHERE b.row = a.row + i AND b.col = a.col + j AND b.v IS NOT NULL)"


def _big(spark, sf):
    hole = (F.floor(c("row") / 3) % 4 == 1) & (F.floor(c("col") / 3) % 3 == 1)
    return rel.img(spark, sf).withColumn("v", F.when(~hole, c("v")))


@query("j17_nearest_fill", "img", f"{_BIG}, n AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, r, c) AS n FROM d WHERE d2 <= 16) SELECT h.row, h.col, round(coalesce(h.v, n.v), 6) + 0.0 AS v FROM h LEFT JOIN n ON h.row = n.row AND h.col = n.col AND n.n = 1")
def j17(spark, sf):
    return grid.fill_by_distance(_big(spark, sf), "v", 4, 2.0, 1).select("row", "col", r6(c("v")).alias("v"))


@query("j18_distance_fill", "img", f"{_BIG}, n AS (SELECT row, col, sum(v / d2) / sum(1 / d2) AS v FROM d WHERE d2 <= 16 GROUP BY row, col) SELECT h.row, h.col, round(coalesce(h.v, n.v), 6) + 0.0 AS v FROM h LEFT JOIN n USING (row, col)")
def j18(spark, sf):
    return grid.fill_by_distance(_big(spark, sf), "v", 4).select("row", "col", r6(c("v")).alias("v"))


@query("j18_exponential_fill", "img", f"{_BIG}, n AS (SELECT row, col, sum(v * exp(-d2 / 2 * 0.3)) / sum(exp(-d2 / 2 * 0.3)) AS v FROM d WHERE d2 <= 16 GROUP BY row, col) SELECT h.row, h.col, round(coalesce(h.v, n.v), 6) + 0.0 AS v FROM h LEFT JOIN n USING (row, col)")
def j18_exponential(spark, sf):
    return grid.fill_by_distance(_big(spark, sf), "v", 4, decay=0.3).select("row", "col", r6(c("v")).alias("v"))


_JUDGED = f", h AS (SELECT row, col, v FROM img){_N3}, m AS (SELECT row, col, median(w) AS m FROM n GROUP BY row, col), d AS (SELECT row, col, any_value(m) AS m, median(abs(w - m)) AS mad FROM n JOIN m USING (row, col) GROUP BY row, col)"


@query("f13_masked_phase", "img", f"{_JUDGED}, k AS (SELECT row, col, CASE WHEN (row + col) % 17 = 0 OR abs(sin(row * 0.3 + col)) < 0.1 OR abs(v - m) > 2.5 * mad THEN NULL ELSE v END AS v FROM h JOIN d USING (row, col)), f AS (SELECT a.row, a.col, any_value(a.v) IS NOT NULL AS valid, coalesce(any_value(a.v), avg(b.v), 0) AS v FROM k a JOIN range(-1, 2) i(i) ON TRUE JOIN range(-1, 2) j(j) ON TRUE JOIN k b ON b.row = a.row + i AND b.col = a.col + j GROUP BY a.row, a.col) SELECT row, col, valid, round(v, 6) + 0.0 AS v FROM f")
def f13_masked(spark, sf):
    """Phases ruled out by a mask, by coherence and by their neighbours, filled by the mean of the valid cells around."""
    d = neighbours.masked_phase(rel.img(spark, sf), "v", (c("row") + c("col")) % 17 == 0, F.abs(F.sin(c("row") * 0.3 + c("col"))), 0.1, 2.5, fill="mean")
    return d.select("row", "col", "valid", r6(c("v")).alias("v"))


@query("f10_culling_modes", "img", f"{_JUDGED} SELECT row, col, round(CASE WHEN abs(sin(row * 0.7 + col)) >= 0.2 AND abs(cos(row * 0.2 - col)) <= 0.9 AND abs(v - m) <= 0.15 THEN v END, 6) + 0.0 AS v FROM h JOIN d USING (row, col)")
def f10_modes(spark, sf):
    """Offsets culled by signal, by variance and by the median around them."""
    d = neighbours.culled(rel.img(spark, sf), "v", F.abs(F.sin(c("row") * 0.7 + c("col"))), 0.2, F.abs(F.cos(c("row") * 0.2 - c("col"))), 0.9, 0.15)
    return d.select("row", "col", r6(c("v")).alias("v"))


@query("f13_phase_preprocessing", "slc", f", t AS (SELECT row, col, atan2(im, re) AS p, abs(re) >= 0.02 AS ok FROM slc) SELECT row, col, round(CASE WHEN ok THEN cos(p) ELSE 0.0 END, 6) + 0.0 AS re, round(CASE WHEN ok THEN sin(p) ELSE 0.0 END, 6) + 0.0 AS im FROM t")
def f13(spark, sf):
    ok, p = F.abs("re") >= 0.02, F.atan2("im", "re")
    return rel.slc(spark, sf).select("row", "col", r6(F.when(ok, F.cos(p)).otherwise(0.0)).alias("re"), r6(F.when(ok, F.sin(p)).otherwise(0.0)).alias("im"))
