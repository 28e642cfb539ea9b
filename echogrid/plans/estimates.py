"""Aggregations and estimators (A)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from echogrid.functions import cplx, radar
from echogrid.operators import looks, neighbours, pol, stats
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6
from echogrid.shared import materialize

c = F.col


def _rounded(df, keys, names=None):
    return df.select(*keys, *(r6(c(x)).alias(x) for x in (names or [x for x in df.columns if x not in keys])))


_SHAPE = "(SELECT max(row) + 1 FROM {0})"


def _blocks(table: str, rl: int, cl: int, select: str, source: str | None = None) -> str:
    t = source or table
    width = 64 if table == "img" else 32
    return f" SELECT CAST(floor(row / {rl}) AS BIGINT) AS row, CAST(floor(col / {cl}) AS BIGINT) AS col, {select} FROM {t} WHERE row < {_SHAPE.format(t)} // {rl} * {rl} AND col < {width // cl * cl} GROUP BY floor(row / {rl}), floor(col / {cl})"


@query("a1_multilook_sum", "img", _blocks("img", 7, 5, "round(sum(v), 6) + 0.0 AS v"))
def a1(spark, sf):
    x = rel.img(spark, sf)
    return _rounded(looks.multilook(x, 7, 5, looks.extent(x), v=F.sum("v")), ["row", "col"])


@query("a2_multilook_mean", "slc", _blocks("slc", 5, 4, "round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im"))
def a2(spark, sf):
    x = rel.slc(spark, sf)
    return _rounded(looks.multilook(x, 5, 4, looks.extent(x), re=F.avg("re"), im=F.avg("im")), ["row", "col"])


@query("a3_multilook_weighted", "img", ", t AS (SELECT row, col, v, CASE WHEN row % 20 < 8 THEN 0.0 ELSE 1.0 + col % 3 END AS w FROM img)" + _blocks("img", 4, 6, "round(sum(w * v) / nullif(sum(w), 0), 6) + 0.0 AS v", "t"))
def a3(spark, sf):
    x = rel.img(spark, sf).withColumn("w", F.when(c("row") % 20 < 8, 0.0).otherwise(1.0 + c("col") % 3))
    return _rounded(looks.multilook(x, 4, 6, looks.extent(x), v=looks.weighted(c("v"), c("w"))), ["row", "col"])


@query("a4_multilook_nodata", "img", ", t AS (SELECT row, col, CASE WHEN (row + col) % 3 = 0 THEN -999.0 ELSE v END AS v FROM img)" + _blocks("img", 4, 4, "round(avg(CASE WHEN v <> -999.0 THEN v END), 6) + 0.0 AS v", "t"))
def a4(spark, sf):
    x = rel.img(spark, sf).withColumn("v", F.when((c("row") + c("col")) % 3 == 0, -999.0).otherwise(c("v")))
    return _rounded(looks.multilook(x, 4, 4, looks.extent(x), v=F.avg(looks.valid(c("v"), -999.0))), ["row", "col"])


@query("a5_multilook_power", "slc", _blocks("slc", 5, 4, "round(avg(pow(sqrt(re * re + im * im), 2.5)), 6) + 0.0 AS v"))
def a5(spark, sf):
    x = rel.slc(spark, sf)
    return _rounded(looks.multilook(x, 5, 4, looks.extent(x), v=looks.power_mean(cplx.pair(), 2.5)), ["row", "col"])


_IFG = ", t AS (SELECT row, col, a.re, a.im, b.re AS bre, b.im AS bim, a.re * b.re + a.im * b.im AS ire, a.im * b.re - a.re * b.im AS iim FROM slc a JOIN sec b USING (row, col))"
_COH = "round(sqrt(pow(avg(ire), 2) + pow(avg(iim), 2)) / nullif(sqrt(avg(re * re + im * im) * avg(bre * bre + bim * bim)), 0), 6) + 0.0 AS coherence"


@query("j1_interferogram", "slc sec", f"{_IFG} SELECT row, col, round(ire, 6) + 0.0 AS ire, round(iim, 6) + 0.0 AS iim FROM t WHERE row >= 0")
def j1(spark, sf):
    return _rounded(looks.interferogram(rel.slc(spark, sf), rel.sec(spark, sf)), ["row", "col"], ["ire", "iim"])


@query("a6_coherence", "slc sec", f"{_IFG}" + _blocks("slc", 5, 4, _COH, "t"))
def a6(spark, sf):
    t = looks.interferogram(rel.slc(spark, sf), rel.sec(spark, sf))
    return _rounded(looks.multilook(t, 5, 4, looks.extent(t), coherence=looks.coherence(cplx.pair(), cplx.pair("b"))), ["row", "col"])


@query("a7_band_looks", "pol", ", s AS (SELECT max(row) + 1 AS n FROM pol) SELECT p, CAST(floor(row / 5) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, round(avg(re * re + im * im), 6) + 0.0 AS v FROM pol, s WHERE row < n // 5 * 5 GROUP BY p, floor(row / 5), floor(col / 4)")
def a7(spark, sf):
    x = rel.pol(spark, sf)
    return _rounded(looks.multilook(x, 5, 4, looks.extent(x), ("p",), v=looks.power_mean(cplx.pair(), 2.0)), ["p", "row", "col"])


@query("a8_raster_stats", "img", "SELECT CAST(floor(row / 50) AS BIGINT) AS block, count(v) AS n, round(min(v), 6) + 0.0 AS least, round(avg(v), 6) + 0.0 AS mean, round(max(v), 6) + 0.0 AS most, round(stddev_samp(v), 6) + 0.0 AS sd FROM img GROUP BY 1")
def a8(spark, sf):
    g = rel.img(spark, sf).groupBy(F.floor(c("row") / 50).alias("block")).agg(*stats.real_stats(c("v")))
    return _rounded(g, ["block", "n"])


@query("a9_complex_stats", "slc", "SELECT CAST(floor(row / 50) AS BIGINT) AS block, count(re) AS n, round(arg_min(re, hypot(re, im)), 6) + 0.0 AS least_re, round(arg_min(im, hypot(re, im)), 6) + 0.0 AS least_im, round(arg_max(re, hypot(re, im)), 6) + 0.0 AS most_re, round(arg_max(im, hypot(re, im)), 6) + 0.0 AS most_im, round(avg(re), 6) + 0.0 AS mean_re, round(avg(im), 6) + 0.0 AS mean_im, round(stddev_samp(sqrt(re * re + im * im)), 6) + 0.0 AS sd FROM slc GROUP BY 1".replace("hypot(re, im)", "sqrt(re * re + im * im)"))
def a9(spark, sf):
    g = rel.slc(spark, sf).groupBy(F.floor(c("row") / 50).alias("block")).agg(*stats.complex_stats(cplx.pair()))
    return _rounded(g, ["block", "n"])


@query("a10_real_imag_stats", "slc", "SELECT col, count(re) AS re_n, round(min(re), 6) + 0.0 AS re_least, round(avg(re), 6) + 0.0 AS re_mean, round(max(re), 6) + 0.0 AS re_most, round(stddev_samp(re), 6) + 0.0 AS re_sd, count(im) AS im_n, round(min(im), 6) + 0.0 AS im_least, round(avg(im), 6) + 0.0 AS im_mean, round(max(im), 6) + 0.0 AS im_most, round(stddev_samp(im), 6) + 0.0 AS im_sd FROM slc GROUP BY col")
def a10(spark, sf):
    g = rel.slc(spark, sf).groupBy("col").agg(*stats.real_stats(c("re"), "re_"), *stats.real_stats(c("im"), "im_"))
    return _rounded(g, ["col", "re_n", "im_n"])


@query("a11_layover_shares", "", "WITH t AS (SELECT vec_id % 7 AS scene, label % 9 AS k FROM embeddings) SELECT scene, round(100 * count_if(k IN (1, 5)) / nullif(count_if(k BETWEEN 0 AND 7), 0), 2) AS shadow, round(100 * count_if(k IN (2, 6)) / nullif(count_if(k BETWEEN 0 AND 7), 0), 2) AS layover, round(100 * count_if(k IN (3, 7)) / nullif(count_if(k BETWEEN 0 AND 7), 0), 2) AS both, round(100 * count_if(k BETWEEN 4 AND 7) / nullif(count_if(k BETWEEN 0 AND 7), 0), 2) AS water FROM t GROUP BY scene")
def a11(spark, sf):
    return rel.read(spark, sf, "embeddings").select((c("vec_id") % 7).alias("scene"), (c("label") % 9).alias("k")).groupBy("scene").agg(*stats.layover_shares(c("k")))


_COV = "round(avg(a.re * b.re + a.im * b.im), 6) + 0.0 AS re, round(avg(a.im * b.re - a.re * b.im), 6) + 0.0 AS im"


@query("a15_covariance", "pol", f", s AS (SELECT max(row) + 1 AS n FROM pol) SELECT a.p AS i, b.p AS j, CAST(floor(a.row / 5) AS BIGINT) AS row, CAST(floor(a.col / 4) AS BIGINT) AS col, {_COV} FROM pol a JOIN pol b ON a.row = b.row AND a.col = b.col AND a.p <= b.p, s WHERE a.row < n // 5 * 5 GROUP BY 1, 2, 3, 4")
def a15(spark, sf):
    x = rel.pol(spark, sf)
    return _rounded(looks.covariance(x, 5, 4, looks.extent(x)), ["i", "j", "row", "col"])


@query("a17_noise_by_difference", "slc", ", d AS (SELECT col, row, lead(re) OVER w - re AS dre, lead(im) OVER w - im AS dim FROM slc WINDOW w AS (PARTITION BY col ORDER BY row)), p AS (SELECT col, row, dre * dre + dim * dim AS p FROM d WHERE dre IS NOT NULL), m AS (SELECT col, avg(p) AS m FROM p GROUP BY col), ms AS (SELECT col, avg(p) AS m FROM p WHERE row % 2 = 0 GROUP BY col), x AS (SELECT col, avg(p) * 0.5 AS diff FROM p JOIN m USING (col) WHERE sqrt(p) < 2 * sqrt(m) GROUP BY col), y AS (SELECT col, avg(p) * 0.5 AS single FROM p JOIN ms USING (col) WHERE row % 2 = 0 AND sqrt(p) < 2 * sqrt(m) GROUP BY col), e AS (SELECT col, pow(re - avg(re) OVER v, 2) + pow(im - avg(im) OVER v, 2) AS p FROM slc WINDOW v AS (PARTITION BY col)), em AS (SELECT col, avg(p) AS m FROM e GROUP BY col), z AS (SELECT col, avg(p) AS mean FROM e JOIN em USING (col) WHERE sqrt(p) < 2 * sqrt(m) GROUP BY col) SELECT col, round(single, 6) + 0.0 AS single, round(diff, 6) + 0.0 AS diff, round(mean, 6) + 0.0 AS mean FROM x JOIN y USING (col) JOIN z USING (col)")
def a17(spark, sf):
    x = rel.slc(spark, sf)
    out = None
    for kind in ("single", "diff", "mean"):
        one = stats.noise_by_difference(x, kind).withColumnRenamed("power", kind)
        out = one if out is None else out.join(one, "col")
    return _rounded(out, ["col"])


@query("a18_noise_by_eigenvalue", "slc", ", b AS (SELECT CAST(floor(a.row / 2) AS BIGINT) AS k, CAST(floor(a.col / 8) AS BIGINT) AS block, avg(a.re * a.re + a.im * a.im) AS p, avg(b.re * b.re + b.im * b.im) AS q, avg(a.re * b.re + a.im * b.im) AS x, avg(a.im * b.re - a.re * b.im) AS y FROM slc a JOIN slc b ON b.row = a.row + 1 AND a.col = b.col WHERE a.row % 2 = 0 GROUP BY 1, 2) SELECT block, round(median((p + q) / 2 - sqrt(pow((p - q) / 2, 2) + x * x + y * y)), 6) + 0.0 AS power FROM b GROUP BY block")
def a18(spark, sf):
    x = rel.slc(spark, sf).withColumn("block", F.floor(c("col") / 8))
    return stats.smallest_eigenvalue_2(x, ["block"]).groupBy("block").agg(r6(F.median("smallest")).alias("power"))


_LAG = ", t AS (SELECT row, col, {0} AS zre, {1} AS zim FROM slc), u AS (SELECT *, lead(zre, {2}) OVER w AS nre, lead(zim, {2}) OVER w AS nim FROM t WINDOW w AS (PARTITION BY col ORDER BY row)), g AS (SELECT CAST(floor(col / 8) AS BIGINT) AS block, avg(nre * zre + nim * zim) AS x, avg(nim * zre - nre * zim) AS y, avg(zre * zre + zim * zim) AS p, avg(nre * nre + nim * nim) AS q FROM u WHERE nre IS NOT NULL GROUP BY 1)"


@query("a20_lag_doppler", "slc", _LAG.format("re", "im", 1) + f" SELECT block, round(atan2(y, x) * {1500 / (2 * math.pi)}, 4) + 0.0 AS doppler, round(sqrt(x * x + y * y) / sqrt(p * q), 6) AS correlation FROM g")
def a20(spark, sf):
    x = rel.slc(spark, sf).withColumn("block", F.floor(c("col") / 8))
    return stats.lag_doppler(x, ["block"], 1500.0).select("block", (F.round("doppler", 4) + F.lit(0.0)).alias("doppler"), r6(c("correlation")).alias("correlation"))


@query("a21_sign_doppler", "slc", _LAG.format("sign(re)", "sign(im)", 2) + f" SELECT block, round(atan2(sin(pi() / 2 * y / sqrt(p * q)), sin(pi() / 2 * x / sqrt(p * q))) * {1500 / (4 * math.pi)}, 4) + 0.0 AS doppler, round(sqrt(x * x + y * y) / sqrt(p * q), 6) AS correlation FROM g")
def a21(spark, sf):
    x = rel.slc(spark, sf).withColumn("block", F.floor(c("col") / 8))
    return stats.lag_doppler(x, ["block"], 1500.0, 2, signs=True).select("block", (F.round("doppler", 4) + F.lit(0.0)).alias("doppler"), r6(c("correlation")).alias("correlation"))


@query("a22_doppler_lut", "slc", f", u AS (SELECT *, lead(re) OVER w AS nre, lead(im) OVER w AS nim FROM slc WINDOW w AS (PARTITION BY col ORDER BY row)), g AS (SELECT CAST(floor(row / 64) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, avg(nre * re + nim * im) AS x, avg(nim * re - nre * im) AS y FROM u WHERE nre IS NOT NULL GROUP BY 1, 2) SELECT row, col, round(atan2(y, x) * {1500 / (2 * math.pi)}, 3) + 0.0 AS doppler FROM g")
def a22(spark, sf):
    x = rel.slc(spark, sf).withColumns({"ab": F.floor(c("row") / 64), "rb": F.floor(c("col") / 4)})
    return stats.lag_doppler(x, ["ab", "rb"], 1500.0).select(c("ab").alias("row"), c("rb").alias("col"), (F.round("doppler", 3) + F.lit(0.0)).alias("doppler"))


@query("a23_trimmed", "img", ", t AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS k, count(v) OVER (PARTITION BY col) AS n FROM img) SELECT col, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd FROM t WHERE k >= floor(0.1 * n) AND k < n - floor(0.1 * n) GROUP BY col")
def a23(spark, sf):
    return _rounded(stats.trimmed(rel.img(spark, sf), ["col"], "v", 0.1), ["col"])


_A24 = ", q AS (SELECT col, quantile_cont(sqrt(re * re + im * im), 0.1) AS lo, quantile_cont(sqrt(re * re + im * im), 0.9) AS hi FROM slc GROUP BY col), m AS (SELECT col, avg(re) AS re, avg(im) AS im FROM slc JOIN q USING (col) WHERE sqrt(re * re + im * im) BETWEEN lo AND hi GROUP BY col)"


def _bounded_mean(x):
    m = F.sqrt(cplx.power(cplx.pair()))
    q = x.groupBy("col").agg(F.percentile(m, F.lit(0.1)).alias("lo"), F.percentile(m, F.lit(0.9)).alias("hi"))
    return x.join(q, "col").where(m.between(c("lo"), c("hi"))).groupBy("col").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


@query("a24_bounded_mean", "slc", f"{_A24} SELECT col, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM m")
def a24(spark, sf):
    return _rounded(_bounded_mean(rel.slc(spark, sf)), ["col"])


@query("a25_channel_ratio", "slc", f"{_A24}, r AS (SELECT a.col, (a.re * b.re + a.im * b.im) / (b.re * b.re + b.im * b.im) AS re, (a.im * b.re - a.re * b.im) / (b.re * b.re + b.im * b.im) AS im FROM m a JOIN m b ON b.col = a.col + 1 WHERE a.col % 2 = 0), p AS (SELECT max(sqrt(re * re + im * im)) AS m FROM r) SELECT col, round(re / m, 6) + 0.0 AS re, round(im / m, 6) + 0.0 AS im FROM r, p")
def a25(spark, sf):
    m = _bounded_mean(rel.slc(spark, sf))
    b = m.select((c("col") - 1).alias("col"), c("re").alias("bre"), c("im").alias("bim"))
    re, im = cplx.divide(cplx.pair(), cplx.pair("b"))
    r = m.where(c("col") % 2 == 0).join(b, "col").select("col", re.alias("re"), im.alias("im"))
    peak = r.agg(F.max(cplx.modulus(cplx.pair())).alias("m"))  # one row
    return _rounded(r.crossJoin(F.broadcast(peak)).select("col", (c("re") / c("m")).alias("re"), (c("im") / c("m")).alias("im")), ["col"])


_WIDE = ", w AS (SELECT row, col, " + ", ".join(f"max(CASE WHEN p = {k} THEN {part} END) AS {n}{part}" for k, n in enumerate(("hh", "hv", "vh", "vv")) for part in ("re", "im")) + " FROM pol GROUP BY row, col HAVING count(DISTINCT p) = 4), b AS (SELECT CAST(floor(row / 8) AS BIGINT) AS block, *, hhre + vvre AS cre, hhim + vvim AS cim, vhre - hvre AS xre, vhim - hvim AS xim FROM w)"


def _wide(spark, sf):
    return pol.wide(rel.pol(spark, sf)).withColumn("block", F.floor(c("row") / 8))


@query("j2_symmetrise", "pol", f"{_WIDE} SELECT row, col, round((hvre + vhre) / 2, 6) + 0.0 AS re, round((hvim + vhim) / 2, 6) + 0.0 AS im FROM b")
def j2(spark, sf):
    return _rounded(pol.symmetrised(_wide(spark, sf)), ["row", "col"])


@query("a31_faraday_bickel", "pol", f"{_WIDE}, f AS (SELECT block, -cim + xre AS ar, cre + xim AS ai, -cim - xre AS br, cre - xim AS bi FROM b) SELECT block, round(atan2(avg(bi * ar - br * ai), avg(br * ar + bi * ai)) / 4, 6) + 0.0 AS angle FROM f GROUP BY block")
def a31(spark, sf):
    return _rounded(pol.faraday_bickel(_wide(spark, sf), ["block"]), ["block"])


@query("a32_faraday_freeman", "pol", f"{_WIDE} SELECT block, round(sign(avg((xre * cre + xim * cim) / nullif(cre * cre + cim * cim, 0))) * atan(sqrt(avg(xre * xre + xim * xim) / nullif(avg(cre * cre + cim * cim), 0))) / 2, 6) + 0.0 AS angle FROM b GROUP BY block")
def a32(spark, sf):
    return _rounded(pol.faraday_freeman(_wide(spark, sf), ["block"]), ["block"])


@query("a33_channel_imbalance", "pol", f"{_WIDE} SELECT block, round(sqrt(avg(hvre * hvre + hvim * hvim) / nullif(avg(vhre * vhre + vhim * vhim), 0)), 6) + 0.0 AS amplitude, round(atan2(avg(hvim * vhre - hvre * vhim), avg(hvre * vhre + hvim * vhim)), 6) + 0.0 AS phase, CASE WHEN avg(hhre * hvre + hhim * hvim) < 0 THEN -1 ELSE 1 END AS sign FROM b GROUP BY block")
def a33(spark, sf):
    return pol.channel_imbalance(_wide(spark, sf), ["block"]).select("block", r6(c("amplitude")).alias("amplitude"), r6(c("phase")).alias("phase"), "sign")


@query("a38_bounding_rectangle", "target", "SELECT CAST(floor(id / 100) AS BIGINT) AS block, floor(min(lon) / 0.5) * 0.5 AS west, ceil(max(lon) / 0.5) * 0.5 AS east, floor(min(lat) / 0.5) * 0.5 AS south, ceil(max(lat) / 0.5) * 0.5 AS north FROM target GROUP BY 1")
def a38(spark, sf):
    g = rel.target(spark, sf).groupBy(F.floor(c("id") / 100).alias("block"))
    return g.agg(radar.snap_down(F.min("lon"), 0.5).alias("west"), radar.snap_up(F.max("lon"), 0.5).alias("east"), radar.snap_down(F.min("lat"), 0.5).alias("south"), radar.snap_up(F.max("lat"), 0.5).alias("north"))


@query("a41_lut_by_range", "img", "SELECT col, round(avg(v), 6) + 0.0 AS v FROM img GROUP BY col")
def a41(spark, sf):
    return rel.img(spark, sf).groupBy("col").agg(r6(F.avg("v")).alias("v"))


@query("a42_elevation_pattern", "slc", ", g AS (SELECT CAST(floor(col / 4) AS BIGINT) AS block, avg((re * re + im * im) * pow((800000.0 + 50 * col) / 800000.0, 3)) AS p FROM slc GROUP BY 1), m AS (SELECT max(p) AS m FROM g) SELECT block, round(p / m, 6) AS p FROM g, m")
def a42(spark, sf):
    p = cplx.power(cplx.pair()) * F.pow(radar.range_of(c("col"), 800000.0, 50.0) / 800000.0, F.lit(3))
    # A row a block of columns, written once for both its uses.
    g = materialize(rel.slc(spark, sf).groupBy(F.floor(c("col") / 4).alias("block")).agg(F.avg(p).alias("p")), "pattern")
    return g.crossJoin(F.broadcast(g.agg(F.max("p").alias("m")))).select("block", r6(c("p") / c("m")).alias("p"))


@query("a43_null_location", "slc", ", g AS (SELECT CAST(floor(row / 50) AS BIGINT) AS block, col, avg(re * re) AS l, avg(im * im) AS r FROM slc GROUP BY 1, 2), f AS (SELECT block, col, round(abs(l - r) / (l + r), 9) AS d FROM g) SELECT block, CAST(min(col) AS INT) AS col FROM f WHERE (block, d) IN (SELECT block, min(d) FROM f GROUP BY block) GROUP BY block")
def a43(spark, sf):
    g = rel.slc(spark, sf).groupBy(F.floor(c("row") / 50).alias("block"), "col").agg(F.avg(c("re") ** 2).alias("l"), F.avg(c("im") ** 2).alias("r"))
    d = F.round(F.abs(c("l") - c("r")) / (c("l") + c("r")), 9)
    return g.groupBy("block").agg(F.min(F.struct(d.alias("d"), "col"))["col"].alias("col"))


@query("a44_offset_stats", "tie", "SELECT scene % 50 AS layer, count(dl) AS n, round(min(dl), 6) AS least, round(avg(dl), 6) AS mean, round(max(dl), 6) AS most, round(stddev_samp(dl), 6) + 0.0 AS sd FROM tie GROUP BY 1")
def a44(spark, sf):
    g = rel.tie(spark, sf).groupBy((c("scene") % 50).alias("layer")).agg(*stats.real_stats(c("dl")))
    return _rounded(g, ["layer", "n"])


@query("a46_side_lobe_ratios", "img", ", k AS (SELECT row, col, v * v AS p, row_number() OVER (PARTITION BY row ORDER BY v * v DESC, col) AS n FROM img), m AS (SELECT row, col AS peak, p AS top FROM k WHERE n = 1), t AS (SELECT row, top, sum(CASE WHEN abs(col - peak) <= 2 THEN p END) AS main, sum(CASE WHEN abs(col - peak) > 2 AND abs(col - peak) <= 20 THEN p END) AS side, max(CASE WHEN abs(col - peak) > 2 AND abs(col - peak) <= 20 THEN p END) AS lobe FROM k JOIN m USING (row) GROUP BY row, top) SELECT row, round(10 * log10(side / main), 4) + 0.0 AS islr, round(10 * log10(lobe / top), 4) + 0.0 AS pslr FROM t")
def a46(spark, sf):
    p = rel.img(spark, sf).withColumn("p", c("v") * c("v"))
    peak = p.groupBy("row").agg(F.max(F.struct("p", (-c("col")).alias("k"))).alias("t")).select("row", c("t.p").alias("top"), (-c("t.k")).alias("peak"))
    d = F.abs(c("col") - c("peak"))
    far = (d > 2) & (d <= 20)
    g = p.join(peak, "row").groupBy("row", "top").agg(F.sum(F.when(d <= 2, c("p"))).alias("main"), F.sum(F.when(far, c("p"))).alias("side"), F.max(F.when(far, c("p"))).alias("lobe"))
    r4 = lambda x: F.round(x, 4) + F.lit(0.0)
    return g.select("row", r4(radar.db(c("side") / c("main"))).alias("islr"), r4(radar.db(c("lobe") / c("top"))).alias("pslr"))


@query("a47_swath_reduction", "channel", "SELECT scene, min(CAST(1500.0 + id % 100 AS DOUBLE)) AS prf, max(width) AS bandwidth, max(center) AS center, min(center - width / 2) AS low, max(center + width / 2) AS high FROM channel GROUP BY scene")
def a47(spark, sf):
    half = c("width") / 2
    return rel.channel(spark, sf).groupBy("scene").agg(F.min(1500.0 + c("id") % 100).alias("prf"), F.max("width").alias("bandwidth"), F.max("center").alias("center"), F.min(c("center") - half).alias("low"), F.max(c("center") + half).alias("high"))


@query("a48_peak_snr", "img", "SELECT CAST(floor(row / 8) AS BIGINT) AS row, CAST(floor(col / 8) AS BIGINT) AS col, round(max(v * v) / ((sum(v * v) - max(v * v)) / nullif(count(*) - 1, 0)), 5) AS snr FROM img GROUP BY 1, 2")
def a48(spark, sf):
    p = c("v") * c("v")
    g = rel.img(spark, sf).groupBy(F.floor(c("row") / 8).alias("row"), F.floor(c("col") / 8).alias("col"))
    return g.agg(F.round(F.max(p) / ((F.sum(p) - F.max(p)) / F.nullif(F.count("*") - 1, F.lit(0))), 5).alias("snr"))


_L1 = f", o AS (SELECT row, col, re, im, {-4 * math.pi * 6.25 / 0.24} * 0.0005 * col AS a FROM slc), t AS (SELECT row, col, o.re, o.im, b.re AS bre, b.im AS bim, (o.re * b.re + o.im * b.im) * cos(a) - (o.im * b.re - o.re * b.im) * sin(a) AS ire, (o.re * b.re + o.im * b.im) * sin(a) + (o.im * b.re - o.re * b.im) * cos(a) AS iim FROM o JOIN sec b USING (row, col))" + _blocks("slc", 5, 4, f"{_COH}, round(atan2(avg(iim), avg(ire)), 5) + 0.0 AS phase, count(*) AS n", "t")


@query("l1_interferogram", "slc sec", _L1)
def l1(spark, sf):
    from echogrid.operators.pipelines import interferogram_product

    t = interferogram_product(rel.slc(spark, sf), rel.sec(spark, sf), 5, 4, offset=0.0005 * c("col"), spacing=6.25, wavelength=0.24)
    return t.select("row", "col", r6(c("coherence")).alias("coherence"), (F.round("phase", 5) + F.lit(0.0)).alias("phase"), "n")


_SMOOTH = lambda x: f"(0.25 * coalesce(lag({x}) OVER w, 0) + 0.5 * {x} + 0.25 * coalesce(lead({x}) OVER w, 0))"


def _filtered_sql() -> str:
    with_part, _, select = _L1.rpartition(" SELECT ")
    one = _SMOOTH
    return (
        f"{with_part}, pr AS (SELECT {select}), z AS (SELECT row, col, coherence * cos(phase) AS x, coherence * sin(phase) AS y FROM pr), "
        f"za AS (SELECT row, col, {one('x')} AS x, {one('y')} AS y FROM z WINDOW w AS (PARTITION BY row ORDER BY col)), "
        f"zb AS (SELECT row, col, {one('x')} AS x, {one('y')} AS y FROM za WINDOW w AS (PARTITION BY col ORDER BY row)) "
        "SELECT row, col, round(x, 4) + 0.0 AS re, round(y, 4) + 0.0 AS im FROM zb"
    )


@query("l1_filtered_interferogram", "slc sec", _filtered_sql())
def l1_filtered(spark, sf):
    """The multilooked interferogram of modulus coherence, low-passed: what the filtered phase is the angle of."""
    p = l1(spark, sf).select("row", "col", (c("coherence") * F.cos("phase")).alias("re"), (c("coherence") * F.sin("phase")).alias("im"))
    k = [0.25, 0.5, 0.25]
    d = neighbours.smooth(p, ["re", "im"], k, k)
    return d.select("row", "col", *((F.round(x, 4) + F.lit(0.0)).alias(x) for x in ("re", "im")))


@query("l1_statistics", "slc sec", _L1.rpartition(" SELECT ")[0] + ", pr AS (SELECT " + _L1.rpartition(" SELECT ")[2] + ") SELECT CAST(floor(col / 4) AS BIGINT) AS part, count(coherence) AS n, round(min(coherence), 5) + 0.0 AS least, round(avg(coherence), 5) AS mean, round(max(coherence), 5) AS most, round(stddev_samp(coherence), 5) AS sd FROM pr GROUP BY 1")
def l1_statistics(spark, sf):
    g = l1(spark, sf).groupBy(F.floor(c("col") / 4).alias("part")).agg(*stats.real_stats(c("coherence")))
    return g.select("part", "n", *((F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("least", "mean", "most", "sd")))
