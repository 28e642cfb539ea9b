"""Noise by blocks of range bins, wide-band interference and the elevation pattern."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.operators import blocks, lines, stats
from echogrid.operators.neighbours import across, blocked, owned
from echogrid.plans import relations as rel
from echogrid.plans.registry import query, r6
from echogrid.shared import materialize

c = F.col
#: Bins of a line, blocks of them, percent of invalid samples that a line may hold, first range and spacing.
WIDTH, BLOCKS, PERCENT, R0, DR = 32, 5, 20.0, 800_000.0, 25.0

_GAP = "(row % 5 = 0 AND col < 4) OR (row % 3 = 1 AND col = 13) OR (col >= 24 AND row <> 7) OR (col BETWEEN 18 AND 20 AND row > 2)"
_VALID = (
    f", z AS (SELECT row, col, CASE WHEN {_GAP} THEN 0 ELSE re END AS re, CASE WHEN {_GAP} THEN 0 ELSE im END AS im, least(col // 6, 4) AS block, min(row) OVER () AS lo, max(row) OVER () AS hi FROM slc)"
    ", g AS (SELECT block, row, 1 - count_if(sqrt(re * re + im * im) > 1e-8) / CASE WHEN block = 4 THEN 8 ELSE 6 END AS bad FROM z WHERE row > lo AND row < hi GROUP BY block, row)"
    ", v AS (SELECT block, row, row_number() OVER (PARTITION BY block ORDER BY row) - 1 AS n, count(*) OVER (PARTITION BY block) AS lines FROM g WHERE bad <= 0.2)"
    ", x AS (SELECT v.*, col, re, im FROM v JOIN z USING (block, row))"
    f", every AS (SELECT b AS block, CAST({R0} + {DR} * (b * 6 + (CASE WHEN b = 4 THEN 7 ELSE 5 END) / 2.0) AS DOUBLE) AS range FROM range(0, 5) t(b))"
)


def _gapped(spark, sf):
    row, col = c("row"), c("col")
    gap = ((row % 5 == 0) & (col < 4)) | ((row % 3 == 1) & (col == 13)) | ((col >= 24) & (row != 7)) | (col.between(18, 20) & (row > 2))
    part = lambda x: F.when(gap, 0.0).otherwise(c(x)).alias(x)
    return rel.slc(spark, sf).select("row", "col", part("re"), part("im"))


@query("a19_valid_eigenvalues", "slc", f"{_VALID}, p AS (SELECT a.block, a.n, a.lines, sum(a.re * a.re + a.im * a.im) AS p, sum(b.re * b.re + b.im * b.im) AS q, sum(a.re * b.re + a.im * b.im) AS x, sum(a.im * b.re - a.re * b.im) AS y FROM x a JOIN x b ON a.block = b.block AND a.col = b.col AND b.n = a.n + 1 WHERE (a.n % 2 = 0 OR a.n = a.lines - 2) GROUP BY a.block, a.n, a.lines), e AS (SELECT block, median((p + q) / 2 - sqrt(pow((p - q) / 2, 2) + x * x + y * y)) / CASE WHEN block = 4 THEN 8 ELSE 6 END AS power FROM p GROUP BY block) SELECT CAST(every.block AS BIGINT) AS block, range, CAST(coalesce((SELECT max(lines) FROM v WHERE v.block = every.block), 0) AS BIGINT) AS lines, round(power, 6) + 0.0 AS power FROM every LEFT JOIN e USING (block)")
def a19_eigenvalues(spark, sf):
    """Noise of five blocks from intervals of two valid lines; first and last line left out, a block of one valid line and one of none without power."""
    d = blocks.noise_by_eigenvalue(_gapped(spark, sf), WIDTH, BLOCKS, R0, DR, interval=2, median=False, percent=PERCENT, ends=True)
    return d.select("block", "range", c("lines").cast("long").alias("lines"), r6(c("power")).alias("power"))


@query("a19_valid_differences", "slc", f"{_VALID}, d AS (SELECT x.block, x.lines, pow(x.re - CASE WHEN x.lines = 1 THEN 0 ELSE l.re END, 2) + pow(x.im - CASE WHEN x.lines = 1 THEN 0 ELSE l.im END, 2) AS p FROM x JOIN x l ON l.block = x.block AND l.col = x.col AND l.n = x.lines - 1 WHERE x.n < x.lines - 1 OR x.lines = 1), m AS (SELECT block, avg(p) AS m FROM d GROUP BY block), e AS (SELECT block, avg(p) * CASE WHEN any_value(lines) = 1 THEN 1 ELSE 0.5 END AS power FROM d JOIN m USING (block) WHERE sqrt(p) < 2 * sqrt(m) GROUP BY block) SELECT CAST(every.block AS BIGINT) AS block, range, CAST(coalesce((SELECT max(lines) FROM v WHERE v.block = every.block), 0) AS BIGINT) AS lines, round(power, 6) + 0.0 AS power FROM every LEFT JOIN e USING (block)")
def a19_differences(spark, sf):
    """Noise of the same blocks from the differences of their valid lines from the last one."""
    d = blocks.noise_by_variance(_gapped(spark, sf), WIDTH, BLOCKS, R0, DR, percent=PERCENT, ends=True)
    return d.select("block", "range", c("lines").cast("long").alias("lines"), r6(c("power")).alias("power"))


#: Bins of a window, the probability of a chance hit and the share of pulses left out.
WINDOW, P_VALUE, TRIM = 5, 0.03, 0.1
_HITS = (
    f", w AS (SELECT row, col, CASE WHEN col <= {WIDTH - WINDOW} THEN log10(avg(re * re + im * im) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)) END AS l FROM slc)"
    ", f AS (SELECT col, regr_slope(l, row) AS b, regr_intercept(l, row) AS a FROM w GROUP BY col), d AS (SELECT row, col, l - a - b * row AS d FROM w JOIN f USING (col) WHERE l IS NOT NULL)"
    ", k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY col) AS n FROM d)"
    f", s AS (SELECT col, avg(d) AS m, stddev_pop(d) AS sd FROM k WHERE k >= round_even({TRIM / 2} * n, 0) AND k < n - round_even({TRIM / 2} * n, 0) GROUP BY col)"
    f", h AS (SELECT row, col, CAST((d - m) / sd > {NormalDist().inv_cdf(1 - P_VALUE)!r} AS INT) AS h FROM d JOIN s USING (col))"
    f", wide AS (SELECT slc.row, slc.col, CAST(CASE WHEN slc.col <= {WIDTH - WINDOW} THEN coalesce(sum(h) OVER (PARTITION BY slc.row ORDER BY slc.col ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) ELSE 0 END AS INT) AS hits FROM slc LEFT JOIN h ON h.row = slc.row AND h.col = slc.col)"
)


def _wide(spark, sf):
    power = rel.slc(spark, sf).select("row", "col", cplx.power(cplx.pair()).alias("power"))
    return blocks.wide_band_hits(power, WIDTH, WINDOW, P_VALUE, TRIM)


@query("a27_wide_band_hits", "slc", f"{_HITS} SELECT row, col, hits FROM wide")
def a27_hits(spark, sf):
    """How many windows of five bins flagged a bin of a pulse, over all pulses."""
    return _wide(spark, sf).select("row", "col", "hits")


_NARROW = (
    ", a AS (SELECT row, col, avg(re * re + im * im) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p FROM slc), nk AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY p) - 1 AS k FROM a), ns AS (SELECT row, avg(p) AS m, stddev_pop(p) AS sd FROM nk WHERE k >= 6 AND k < 26 GROUP BY row)"
    ", nf AS (SELECT a.row, a.col, CAST((p - m) / sd > 2.0 AS INT) AS f, max(a.row) OVER () AS most FROM a JOIN ns USING (row)), narrow AS (SELECT row, col, CAST(CASE WHEN row + 4 <= most THEN sum(f) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) ELSE 0 END AS INT) AS narrow FROM nf)"
)


@query("a27_detection_mask", "slc", f"{_HITS}{_NARROW}, bo AS (SELECT row, col, hits, narrow FROM wide JOIN narrow USING (row, col)), q AS (SELECT quantile_cont(hits, 0.9) AS qw, quantile_cont(narrow, 0.9) AS qn FROM bo) SELECT row, col, hits, narrow FROM bo, q WHERE hits > qw OR narrow > qn")
def a27_mask(spark, sf):
    """Cells whose hits of either kind, wide band or stationary narrow band, are beyond the image's upper tenth."""
    near = blocked(rel.slc(spark, sf).select("row", "col", cplx.power(cplx.pair()).alias("q")), 4)
    a = owned(near.withColumn("p", F.avg("q").over(across().rowsBetween(-4, 0)))).select("row", "col", "p")
    s = stats.trimmed(a, ["row"], "p", 0.2)
    flags = a.join(s, "row").withColumn("f", (c("p") - c("mean")) / c("sd") > 2.0)
    narrow = stats.window_hits(flags, c("f"), 5).select("row", "col", c("hits").alias("narrow"))
    both = materialize(_wide(spark, sf).select("row", "col", "hits").join(narrow, ["row", "col"]), "hits")
    return blocks.detections(both, ["hits", "narrow"], 0.1).where("loud").select("row", "col", "hits", "narrow")


#: A chirp of five samples, bins of a block of the pattern, and the radii of platform and ground.
CHIRP, SIZE, PLATFORM, GROUND = blocks.raised_cosine_chirp(0.06, 4.0, 1.0, 0.3), 3, 7_118_000.0, 6_371_000.0
_TAPS = [(j, float(z.real), float(z.imag)) for j, z in enumerate(CHIRP)]
_AHEAD = lambda x, j: f"lead({x}, {j}) OVER w" if j else x
_COMPRESSED = (
    ", o AS (SELECT row, col, " + " + ".join(f"({re!r}) * {_AHEAD('re', j)} + ({im!r}) * {_AHEAD('im', j)}" for j, re, im in _TAPS) + " AS re, " + " + ".join(f"({re!r}) * {_AHEAD('im', j)} - ({im!r}) * {_AHEAD('re', j)}" for j, re, im in _TAPS) + " AS im FROM slc WINDOW w AS (PARTITION BY row ORDER BY col))"
    f", g AS (SELECT CAST(floor(col / {SIZE}) AS BIGINT) AS block, avg(re * re + im * im) AS p FROM o WHERE col < 27 GROUP BY 1), rg AS (SELECT *, {R0 + DR * (SIZE - 1) / 2} AS start, {R0 + DR * (SIZE - 1) / 2} + block * {SIZE * DR} AS range FROM g)"
    f", an AS (SELECT *, acos(({PLATFORM**2} + range * range - {GROUND**2}) / (2 * {PLATFORM} * range)) AS look, acos(({PLATFORM**2 - GROUND**2} - range * range) / (2 * {GROUND} * range)) AS inc, acos(({PLATFORM**2 - GROUND**2} - start * start) / (2 * {GROUND} * start)) AS inc0 FROM rg), cp AS (SELECT *, p * pow(range / start, 3) * tan(inc) / tan(inc0) AS cal FROM an), pt AS (SELECT block, range, look, inc, 10 * log10(cal / max(cal) OVER ()) AS db FROM cp)"
)


def _pattern(spark, sf):
    compressed = lines.compress(lines.to_lines(rel.slc(spark, sf), ["row"]), ["row"], CHIRP, "valid")
    return blocks.elevation_pattern(lines.to_cells(compressed, ["row"]), WIDTH - len(CHIRP) + 1, SIZE, R0, DR, PLATFORM, GROUND)


@query("a42_incidence_calibrated", "slc", f"{_COMPRESSED} SELECT block, CAST(range AS DOUBLE) AS range, round(look, 8) AS look, round(inc, 8) AS incidence, round(db, 5) + 0.0 AS db FROM pt")
def a42_calibrated(spark, sf):
    """The two-way pattern of range-compressed lines, calibrated by range and incidence, in decibels below its peak."""
    d = _pattern(spark, sf)
    return d.select("block", "range", F.round("look", 8).alias("look"), F.round("incidence", 8).alias("incidence"), (F.round("db", 5) + F.lit(0.0)).alias("db"))


@query("a42_fitted_pattern", "slc", f"{_COMPRESSED}, n AS (SELECT *, (look - avg(look) OVER ()) / stddev_samp(look) OVER () AS t FROM pt), mo AS (SELECT count(*) AS n, sum(t) AS s1, sum(t * t) AS s2, sum(pow(t, 3)) AS s3, sum(pow(t, 4)) AS s4, sum(db) AS y0, sum(db * t) AS y1, sum(db * t * t) AS y2 FROM n), de AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM mo), co AS (SELECT (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / det AS a, (n * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / det AS b, (n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / det AS c FROM de) SELECT block, round(db, 5) + 0.0 AS db, round(a + b * t + c * t * t, 5) + 0.0 AS fitted FROM n, co")
def a42_fitted(spark, sf):
    """The pattern and its polynomial of degree two in the look angle."""
    d = blocks.smooth_pattern(_pattern(spark, sf), 2)
    return d.select("block", *((F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("db", "fitted")))
