"""Raster statistics and robust summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.operators import asof
from echogrid.operators.neighbours import Keys, across, blocked, owned


def real_stats(x: Column, prefix: str = "") -> list[Column]:
    """Aggregates: valid cells, least, mean, greatest, sample deviation (0 for one cell)."""
    named = {"n": F.count(x), "least": F.min(x), "mean": F.avg(x), "most": F.max(x), "sd": F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0)}
    return [v.alias(prefix + k) for k, v in named.items()]


def complex_stats(z: cplx.Pair) -> list[Column]:
    """Aggregates: least and greatest cells by modulus, the complex mean, the deviation of the modulus."""
    m = cplx.modulus(z)
    both = F.struct(z[0].alias("re"), z[1].alias("im"))
    least, most = F.min_by(both, m), F.max_by(both, m)
    return [F.count(m).alias("n"), least["re"].alias("least_re"), least["im"].alias("least_im"), most["re"].alias("most_re"), most["im"].alias("most_im"), F.avg(z[0]).alias("mean_re"), F.avg(z[1]).alias("mean_im"), F.stddev_samp(m).alias("sd")]


def layover_shares(code: Column) -> list[Column]:
    """Aggregates: percent of valid codes 0 to 7 that are shadow, layover, both and water."""
    ok = F.count_if(code.between(0, 7))
    share = lambda test: F.round(100 * F.count_if(test) / F.nullif(ok, F.lit(0)), 2)
    return [share(code.isin(1, 5)).alias("shadow"), share(code.isin(2, 6)).alias("layover"), share(code.isin(3, 7)).alias("both"), share(code.between(4, 7)).alias("water")]


def trimmed(df: DataFrame, keys: list[str], x: str, share: float) -> DataFrame:
    """Mean and population deviation of each group without that share of its rows at either end."""
    w = Window.partitionBy(*keys).orderBy(x)
    n, cut = F.count(x).over(Window.partitionBy(*keys)), F.lit(share)
    ranked = df.withColumns({"_k": F.row_number().over(w) - 1, "_n": n})
    low = F.floor(cut * F.col("_n"))
    return ranked.where((F.col("_k") >= low) & (F.col("_k") < F.col("_n") - low)).groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def noise_by_difference(lines: DataFrame, kind: str = "single", keys: Keys = ()) -> DataFrame:
    """``keys, col, power``: noise of each range bin from differences of neighbouring lines, those over two deviations dropped.

    ``single``: lines 0 and 1, 2 and 3, ...; ``diff``: all neighbours; both count half. ``mean``: each line less its bin's mean.
    """
    of = [*keys, "col"]
    if kind == "mean":
        means = lines.groupBy(*of).agg(F.avg("re").alias("_re"), F.avg("im").alias("_im"))
        d = lines.join(means, of).select(*of, (F.col("re") - F.col("_re")).alias("dre"), (F.col("im") - F.col("_im")).alias("dim"))
    else:
        w = across(keys)
        d = blocked(lines, 1, keys).withColumns({"dre": F.lead("re").over(w) - F.col("re"), "dim": F.lead("im").over(w) - F.col("im")})
        d = owned(d).where(F.col("dre").isNotNull())
        if kind == "single":
            d = d.where(F.col("row") % 2 == 0)
    scale = 1.0 if kind == "mean" else 0.5
    p = d.select(*of, (F.col("dre") ** 2 + F.col("dim") ** 2).alias("p"))
    bound = p.groupBy(*of).agg(F.avg("p").alias("m"))
    return p.join(bound, of).where(F.sqrt("p") < 2 * F.sqrt("m")).groupBy(*of).agg((F.avg("p") * scale).alias("power"))


def smallest_eigenvalue_2(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The smaller eigenvalue of the covariance of lines ``2k`` and ``2k + 1`` for each group and k."""
    a = lines.where(F.col("row") % 2 == 0).withColumn("k", F.floor(F.col("row") / 2))
    b = lines.where(F.col("row") % 2 == 1).select((F.floor(F.col("row") / 2)).alias("k"), "col", F.col("re").alias("bre"), F.col("im").alias("bim"))
    re, im = cplx.conj_mul(cplx.pair(), cplx.pair("b"))
    both = a.join(b, ["k", "col"])
    m = both.groupBy(*keys, "k").agg(F.avg(cplx.power(cplx.pair())).alias("p"), F.avg(cplx.power(cplx.pair("b"))).alias("q"), F.avg(re).alias("x"), F.avg(im).alias("y"))
    half = (F.col("p") + F.col("q")) / 2
    root = F.sqrt(((F.col("p") - F.col("q")) / 2) ** 2 + F.col("x") ** 2 + F.col("y") ** 2)
    return m.select(*keys, "k", (half - root).alias("smallest"))


def lag_doppler(lines: DataFrame, keys: list[str], prf: float, lag: int = 1, signs: bool = False, image: Keys = ()) -> DataFrame:
    """Doppler frequency of each group from the product of cells ``lag`` lines apart, and its correlation; ``image``: columns that name the image."""
    w = across(image)
    z = (F.signum("re"), F.signum("im")) if signs else cplx.pair()
    near = lines.select(*lines.columns, z[0].alias("zre"), z[1].alias("zim"))
    near = blocked(near, lag, image).withColumns({"nre": F.lead("zre", lag).over(w), "nim": F.lead("zim", lag).over(w)})
    near = owned(near).where(F.col("nre").isNotNull())
    re, im = cplx.conj_mul(cplx.pair("n"), cplx.pair("z"))
    g = near.groupBy(*keys).agg(F.avg(re).alias("x"), F.avg(im).alias("y"), F.avg(cplx.power(cplx.pair("z"))).alias("p"), F.avg(cplx.power(cplx.pair("n"))).alias("q"))
    if signs:
        norm = F.nullif(F.sqrt(F.col("p") * F.col("q")), F.lit(0.0))
        x, y = F.sin(math.pi / 2 * F.col("x") / norm), F.sin(math.pi / 2 * F.col("y") / norm)
    else:
        x, y = F.col("x"), F.col("y")
    return g.select(*keys, (F.atan2(y, x) * (prf / (2 * math.pi * lag))).alias("doppler"), (F.hypot("x", "y") / F.nullif(F.sqrt(F.col("p") * F.col("q")), F.lit(0.0))).alias("correlation"))


def window_hits(cells: DataFrame, flag: Column, size: int, image: Keys = ()) -> DataFrame:
    """``cells`` with ``hits``: how many of the ``size`` windows of lines that hold a cell end with its flag set.

    A window ends at each line from the cell's own on; the last ``size - 1`` lines of an image have not
    been passed by all of theirs and stay 0.
    """
    last = cells.groupBy(*image).agg(F.max("row").alias("_last"))
    d = cells.join(last, list(image)) if image else cells.crossJoin(F.broadcast(last))
    d = blocked(d.withColumn("_f", flag.cast("int")), size - 1, image)
    d = owned(d.withColumn("hits", F.sum("_f").over(across(image).rowsBetween(0, size - 1))))
    return d.withColumn("hits", F.when(F.col("row") + size - 1 <= F.col("_last"), F.col("hits")).otherwise(0).cast("int")).drop("_f", "_last")


def noise_by_interval(values: DataFrame, interval: int, scale: float = 1.0, median: bool = False, keys: Keys = ()) -> DataFrame:
    """``keys, intervals, power``: the median over intervals of the least eigenvalue of their covariances (``k, values``, the largest first).

    ``median``: of each interval the median of all but its largest eigenvalue instead. Intervals of fewer lines go.
    """
    whole = values.where(F.size("values") == interval)
    rest = F.array_sort(F.slice("values", 2, interval - 1))
    own = (F.get(rest, F.lit((interval - 2) // 2)) + F.get(rest, F.lit((interval - 1) // 2))) / 2 if median else F.get("values", F.lit(interval - 1))
    g = whole.select(*keys, own.alias("_p")).groupBy(*keys).agg(F.count("*").alias("intervals"), (F.median("_p") * scale).alias("power"))
    return g


#: Ratios of the deviations of the largest and the least eigenvalues' steps, and how many deviations the threshold then takes.
STEP_RATIOS, STEP_DEVIATIONS = (2.0, 20.0), (5.0, 2.0)


def eigenvalue_threshold(values: DataFrame, block: int, leading: int, least: int, ratios: tuple[float, float] = STEP_RATIOS, deviations: tuple[float, float] = STEP_DEVIATIONS) -> DataFrame:
    """``block, intervals, ratio, threshold`` of each block of so many intervals ``k``: a slope in decibels between eigenvalues beyond which they are interference.

    Of the ``leading`` eigenvalues that with the greatest deviation over the block's intervals, and the
    eigenvalue of index ``least``, are followed from interval to interval. The ratio of the
    deviations of their steps says how strong interference is, and by a straight line how many deviations
    of the least one's steps, from their mean, are taken. Without such deviation a block has no
    ratio and no threshold, and nothing of it is loud.
    """
    db = lambda k: 10 * F.log10(F.abs(F.get("values", F.lit(k))))
    d = values.withColumns({"block": F.floor(F.col("k") / block), "_low": db(least)} | {f"_top{i}": db(i) for i in range(leading)})
    w = Window.partitionBy("block").orderBy("k")
    names = ["_low", *(f"_top{i}" for i in range(leading))]
    d = d.withColumns({f"{n}_step": F.col(n) - F.lag(n).over(w) for n in names})
    tops = [F.struct(F.stddev_pop(f"_top{i}").alias("sd"), F.lit(-i).alias("i"), F.stddev_pop(f"_top{i}_step").alias("step")) for i in range(leading)]
    best = F.array_max(F.array(*tops))["step"]
    g = d.groupBy("block").agg(F.count("*").alias("intervals"), (best / F.nullif(F.stddev_pop("_low_step"), F.lit(0.0))).alias("ratio"), F.stddev_pop("_low_step").alias("_sd"), F.avg("_low_step").alias("_mean"))
    share = F.least(F.greatest((F.col("ratio") - ratios[0]) / (ratios[1] - ratios[0]), F.lit(0.0)), F.lit(1.0))
    return g.withColumn("threshold", F.col("_mean") + (deviations[0] + share * (deviations[1] - deviations[0])) * F.col("_sd")).drop("_sd", "_mean")


def loud_eigenvalues(values: DataFrame, thresholds: DataFrame, block: int, most: int) -> DataFrame:
    """``k, loud``: how many of the leading eigenvalues of each interval are interference: up to the last of the first ``most`` falls that exceed its block's threshold."""
    d = values.withColumn("block", F.floor(F.col("k") / block)).join(thresholds.select("block", "threshold"), "block")
    fall = lambda i: 10 * (F.log10(F.abs(F.get("values", F.lit(i + 1)))) - F.log10(F.abs(F.get("values", F.lit(i)))))
    hits = [F.when(fall(i) < -F.col("threshold"), i + 1).otherwise(0) for i in range(most)]
    return d.select("k", (F.greatest(*hits) if most > 1 else hits[0]).alias("loud"))


def spectral_slope(bins: DataFrame, n: int, half_width: float, rate: float, frequency: float, keys: Keys = ()) -> DataFrame:
    """``keys, bins, slope, doppler``: Doppler without ambiguity from the phase of neighbouring lines' products in each bin of the range spectrum.

    ``bins``: ``col`` (of frequency ``(col - n // 2) / n`` cycles a sample) and ``phase``; those within ``half_width``
    cycles count. Their phases are unwrapped by frequency and fitted by a line; its slope times the line ``rate``
    and the carrier ``frequency`` (in samples' rate too) is the Doppler there.
    """
    reach = int(half_width * n)
    d = bins.where(F.col("col").between(n // 2 - reach, n // 2 + reach - (n + 1) % 2))
    d = asof.unwrapped(d, list(keys) or ["_all"], "col", "phase") if keys else asof.unwrapped(d.withColumn("_all", F.lit(0)), ["_all"], "col", "phase")
    g = d.groupBy(*keys).agg(F.count("*").alias("bins"), F.regr_slope("unwrapped", (F.col("col") - n // 2) / F.lit(float(n))).alias("slope"))
    return g.withColumn("doppler", F.col("slope") * (frequency * rate / (2 * math.pi)))
