"""Estimates by blocks of range bins: noise with rules of validity, wide-band interference, the elevation pattern."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import cplx, radar
from echogrid.operators import fit
from echogrid.operators.neighbours import Keys
from echogrid.shared import materialize

#: Fixed values of the noise rules: percent of invalid samples that a line may hold, the modulus up to which a sample is
#: invalid, fewest lines and greatest number of intervals aimed at, most lines of an interval.
INVALID, ZERO, FEWEST_LINES, INTERVALS, MOST_LINES = 10.0, 1e-8, 3, 8, 100
#: Lines that are numbered together.
CHUNK = 4096


def block_of(col: Column, width: int, blocks: int) -> Column:
    """The block of a range bin: equal ones, the last one takes what is left."""
    return F.least(F.floor(col / (width // blocks)), F.lit(blocks - 1))


def _bins(width: int, blocks: int) -> Column:
    size = width // blocks
    return F.when(F.col("block") == blocks - 1, width - size * (blocks - 1)).otherwise(size)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (of distinct ``keys, row``) with ``n``, their number by row from 0, and ``lines``, how many there are.

    Chunks of rows are counted first, so only a chunk's rows, and a group's chunks, are sorted together.
    """
    d = rows.withColumn("_chunk", F.floor(F.col("row") / CHUNK))
    counts = d.groupBy(*keys, "_chunk").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    before = F.sum("_k").over(w.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_k").over(w).alias("lines"))
    own = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("row"))
    return d.join(starts, [*keys, "_chunk"]).withColumn("n", F.col("_start") + own - 1).drop("_chunk", "_start")


def valid_lines(cells: DataFrame, width: int, blocks: int, percent: float = INVALID, ends: bool = False, keys: Keys = ()) -> DataFrame:
    """``keys, block, row, n, lines``: the lines of each block of which at most so many percent of samples are invalid, numbered.

    Samples of zero, null ones and those that are not listed are invalid. ``ends``: an image's
    first and last line go first. Written to the shared folder: a row a line and block.
    """
    d = cells
    if ends:
        edge = cells.groupBy(*keys).agg(F.min("row").alias("_first"), F.max("row").alias("_last"))
        d = (d.join(edge, list(keys)) if keys else d.crossJoin(F.broadcast(edge))).where((F.col("row") > F.col("_first")) & (F.col("row") < F.col("_last")))
    good = F.count_if(cplx.modulus(cplx.pair()) > ZERO)
    g = d.groupBy(*keys, block_of(F.col("col"), width, blocks).alias("block"), "row").agg(good.alias("_good"))
    bins = _bins(width, blocks)
    kept = g.where((bins - F.col("_good")) / bins <= percent / 100).drop("_good")
    return materialize(numbered(materialize(kept, "valid"), [*keys, "block"]), "lines")


def _all_blocks(cells: DataFrame, found: DataFrame, width: int, blocks: int, r0: float, spacing: float, keys: Keys) -> DataFrame:
    """Every block of every image with its middle range; those without an estimate have none."""
    images = cells.select(*keys).distinct() if keys else cells.groupBy().agg(F.count("*").alias("_n")).drop("_n")
    size = width // blocks
    every = images.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    first = F.col("block") * size
    middle = r0 + spacing * (first + (_bins(width, blocks) - 1) / 2)
    d = every.withColumn("range", middle).join(found, [*keys, "block"], "left")
    return d.withColumn("lines", F.coalesce("lines", F.lit(0)))


def noise_by_eigenvalue(cells: DataFrame, width: int, blocks: int, r0: float, spacing: float, interval: int | None = None, median: bool = True, percent: float = INVALID, ends: bool = False, scale: float = 1.0, keys: Keys = ()) -> DataFrame:
    """``keys, block, range, lines, interval, power``: noise of each block of bins from eigenvalues of intervals of its valid lines.

    An interval has ``interval`` lines (no more than there are), or an eighth of the block's lines,
    three at least and 100 at most. The last interval ends with the last line, so it may
    share lines with the one before. Its noise is the least eigenvalue of its covariance, or the
    ``median`` of all but the greatest; a block's is the median over its intervals. Blocks of
    fewer than two valid lines have no power.
    """
    lines = valid_lines(cells, width, blocks, percent, ends, keys)
    count = F.col("lines")
    wanted = F.lit(interval) if interval else F.least(F.greatest(F.least(count, F.lit(FEWEST_LINES)), F.ceil(count / INTERVALS)), F.lit(MOST_LINES))
    d = lines.where(count > 1).withColumn("interval", F.least(wanted, count).cast("int"))
    last = F.ceil(count / F.col("interval")) - 1
    own = F.floor(F.col("n") / F.col("interval"))
    mine = F.array(F.when(own < last, own), F.when(F.col("n") >= count - F.col("interval"), last))
    d = d.withColumn("k", F.explode(F.array_compact(mine)))
    of = [*keys, "block"]
    # The line's place within its interval: the last one is counted from the block's end.
    place = F.when(F.col("k") == last, F.col("n") - count + F.col("interval")).otherwise(F.col("n") - F.col("k") * F.col("interval"))
    d = d.withColumn("i", place.cast("int"))
    size = width // blocks
    samples = cells.where(cplx.modulus(cplx.pair()) > ZERO).withColumn("block", block_of(F.col("col"), width, blocks))
    j = d.join(samples.select(*of, "row", (F.col("col") - F.col("block") * size).cast("int").alias("at"), "re", "im"), [*of, "row"])
    # At most 100 lines of one block's bins, unless a longer interval is asked for.
    named = [*of, "k", "lines", "interval"]
    j = j.groupBy(*named).agg(F.collect_list(F.struct("i", "at", "re", "im")).alias("s")).select(*named, _bins(width, blocks).alias("bins"), "s.i", "s.at", "s.re", "s.im")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            power = np.full(len(p), np.nan)
            for g, (n, bins, i, at, re, im) in enumerate(zip(*(p[x] for x in ("interval", "bins", "i", "at", "re", "im")), strict=True)):
                z = np.zeros((n, bins), complex)
                z[i, at] = re + 1j * im
                values = np.linalg.eigvalsh(z @ z.conj().T / bins)
                power[g] = np.median(values[:-1]) if median else values[0]
            yield p[named].assign(power=power)

    kinds = dict(j.dtypes)
    each = j.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in named) + ", power double")
    found = each.groupBy(*of, "lines", "interval").agg((F.median("power") * scale).alias("power"))
    counts = lines.groupBy(*of).agg(F.first("lines").alias("lines"))
    found = counts.join(found.drop("lines"), of, "left")
    return _all_blocks(cells, found, width, blocks, r0, spacing, keys)


def noise_by_variance(cells: DataFrame, width: int, blocks: int, r0: float, spacing: float, kind: str = "single", percent: float = INVALID, ends: bool = False, scale: float = 1.0, keys: Keys = ()) -> DataFrame:
    """``keys, block, range, lines, power``: noise of each block of bins from the differences of its valid lines.

    ``single``: all lines less the last one; ``diff``: neighbours; both count half. ``mean``: lines less
    each bin's mean. Differences of two deviations or more are dropped. One line alone is taken as it is.
    """
    of = [*keys, "block"]
    lines = valid_lines(cells, width, blocks, percent, ends, keys)
    part = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    d = cells.select(*keys, block_of(F.col("col"), width, blocks).alias("block"), "row", "col", part("re"), part("im")).join(lines, [*of, "row"])
    if kind == "mean":
        other = d.groupBy(*of, "col").agg(F.avg("re").alias("_re"), F.avg("im").alias("_im"))
        j = d.join(other, [*of, "col"])
    elif kind == "single":
        other = d.where(F.col("n") == F.col("lines") - 1).select(*of, "col", F.col("re").alias("_re"), F.col("im").alias("_im"))
        j = d.join(other, [*of, "col"]).where((F.col("n") < F.col("lines") - 1) | (F.col("lines") == 1))
    else:
        other = d.select(*of, "col", (F.col("n") - 1).alias("n"), F.col("re").alias("_re"), F.col("im").alias("_im"))
        j = d.join(other, [*of, "col", "n"], "left").where((F.col("n") < F.col("lines") - 1) | (F.col("lines") == 1))
    alone = F.col("lines") == 1
    less = lambda x: F.col(x) - F.when(alone, 0.0).otherwise(F.col(f"_{x}"))
    p = j.select(*of, "lines", (less("re") ** 2 + less("im") ** 2).alias("p"))
    bound = p.groupBy(*of).agg(F.avg("p").alias("m"))
    half = 1.0 if kind == "mean" else 0.5
    # The bounds are a row a block; a block's differences stay where they are.
    kept = p.join(bound, of).withColumn("p", F.when(F.sqrt("p") < 2 * F.sqrt("m"), F.col("p")))
    found = kept.groupBy(*of).agg(F.first("lines").alias("lines"), (F.avg("p") * F.when(F.first("lines") == 1, 1.0).otherwise(half) * scale).alias("power"))
    return _all_blocks(cells, found, width, blocks, r0, spacing, keys)


def wide_band_hits(cells: DataFrame, width: int, size: int, p_value: float, trim: float, keys: Keys = ()) -> DataFrame:
    """``cells`` (``keys, row, col, power``; a row is a pulse, a column a bin of the range spectrum) with ``hits``: wide-band interference that comes and goes.

    A window of ``size`` bins is averaged, put on a log scale and stripped of its straight line over
    the pulses. Where it exceeds its mean by what a normal variable does with probability
    ``p_value`` (mean and deviation without ``trim`` of the pulses, half at either end) it is a
    hit. A bin counts the windows that hold it as their last bins do: those from ``size - 1`` before its
    own to its own. Bins within ``size - 1`` of the end have no window of their own and no hits.
    """
    if not 0 < size <= width or not 0 < p_value < 1 or not 0 <= trim < 1:
        raise ValueError("a window is within the spectrum, shares are between 0 and 1")
    line = Window.partitionBy(*keys, "row").orderBy("col")
    whole = F.col("col") + size <= width
    d = cells.withColumn("_l", F.when(whole, F.log10(F.avg("power").over(line.rangeBetween(0, size - 1)))))
    of = [*keys, "col"]
    lines = d.groupBy(*of).agg(F.regr_slope("_l", "row").alias("_b"), F.regr_intercept("_l", "row").alias("_a"))
    d = materialize(d.join(lines, of).withColumn("_d", F.col("_l") - F.col("_a") - F.col("_b") * F.col("row")).drop("_l", "_a", "_b"), "detrended")
    ranked = d.where(F.col("_d").isNotNull()).withColumns({"_k": F.row_number().over(Window.partitionBy(*of).orderBy("_d")) - 1, "_n": F.count("*").over(Window.partitionBy(*of))})
    cut = F.rint(trim / 2 * F.col("_n"))
    s = ranked.where((F.col("_k") >= cut) & (F.col("_k") < F.col("_n") - cut)).groupBy(*of).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_sd"))
    bound = NormalDist().inv_cdf(1 - p_value)
    hit = F.coalesce(((F.col("_d") - F.col("_m")) / F.nullif(F.col("_sd"), F.lit(0.0)) > bound).cast("int"), F.lit(0))
    d = d.join(s, of, "left").withColumn("_hit", hit)
    hits = F.when(whole, F.sum("_hit").over(line.rangeBetween(1 - size, 0))).otherwise(0).cast("int")
    return d.withColumn("hits", hits).drop("_d", "_m", "_sd", "_hit")


def detections(cells: DataFrame, counts: list[str], share: float, keys: Keys = ()) -> DataFrame:
    """``cells`` with ``loud``: whether any of the counts exceeds its quantile of ``1 - share`` over the image.

    The quantiles are exact: counts of windows have few values, and an aggregate holds one number a value.
    """
    bounds = cells.groupBy(*keys).agg(*(F.percentile(k, F.lit(1 - share)).alias(f"_{k}") for k in counts))
    d = cells.join(bounds, list(keys)) if keys else cells.crossJoin(F.broadcast(bounds))
    loud = F.lit(False)
    for k in counts:
        loud = loud | (F.col(k) > F.col(f"_{k}"))
    return d.withColumn("loud", loud).drop(*(f"_{k}" for k in counts))


def raised_cosine_chirp(slope: float, duration: float, rate: float, pedestal: float) -> np.ndarray:
    """Samples of a linear chirp of unit energy under a raised cosine that falls to ``pedestal`` at its ends."""
    n = int(duration * rate) + 1
    k = np.arange(n) - (n - 1) / 2
    shape = (1 + pedestal) / 2 + (1 - pedestal) / 2 * np.cos(2 * np.pi * k / max(n - 1, 1))
    z = shape * np.exp(1j * np.pi * slope * (k / rate) ** 2)
    return z / np.linalg.norm(z)


def elevation_pattern(cells: DataFrame, bins: int, size: int, r0: float, spacing: float, platform: float, ground: float, by_incidence: bool = True, one_way: bool = False, keys: Keys = ()) -> DataFrame:
    """``keys, block, range, look, incidence, db``: the power of ``cells`` (compressed lines of ``bins`` samples) over range, calibrated and against its peak.

    Powers are averaged over lines and ``size`` bins (left over bins go), multiplied by the cube of the range over
    the first block's, and by the tangent of the incidence over the first one's. ``platform`` and
    ``ground`` are radii; ``one_way`` halves the decibels.
    """
    blocks = bins // size
    g = cells.where(F.col("col") < blocks * size).groupBy(*keys, F.floor(F.col("col") / size).alias("block")).agg(F.avg(cplx.power(cplx.pair())).alias("_p"))
    start = r0 + (size - 1) / 2 * spacing
    at = F.lit(platform), F.lit(ground)
    d = g.withColumn("range", start + F.col("block") * (size * spacing))
    d = d.withColumns({"look": radar.look_angle(*at, F.col("range")), "incidence": radar.incidence(*at, F.col("range"))})
    p = F.col("_p") * F.pow(F.col("range") / start, F.lit(3))
    if by_incidence:
        p = p * F.tan("incidence") / F.tan(radar.incidence(*at, F.lit(start)))
    d = d.withColumn("_p", p)
    # A row a block of bins, so a window holds no more than a line's blocks.
    top = F.max("_p").over(Window.partitionBy(*keys))
    return d.withColumn("db", (5 if one_way else 10) * F.log10(F.col("_p") / F.nullif(top, F.lit(0.0)))).drop("_p")


def smooth_pattern(pattern: DataFrame, degree: int, keys: Keys = ()) -> DataFrame:
    """``pattern`` with ``fitted``: the polynomial in the look angle, centred and scaled, that fits the decibels best."""
    of = list(keys) or ["_all"]
    d = pattern if keys else pattern.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*of)
    d = materialize(d.withColumn("_x", (F.col("look") - F.avg("look").over(w)) / F.stddev_samp("look").over(w)), "pattern")
    terms = fit.powers(F.col("_x"), degree)
    k = fit.solve(d.where(F.col("db").isNotNull()), of, terms, F.col("db")).drop("n")
    return d.join(k, of).withColumn("fitted", fit.value(terms)).drop("_x", "_all", *(f"k{i}" for i in range(degree + 1)))
