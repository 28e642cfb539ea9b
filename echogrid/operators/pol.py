"""Polarimetric estimators over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.functions.cplx import add, conj_mul, power, sub


def wide(channels: DataFrame, whole: bool = True) -> DataFrame:
    """``row, col`` and ``hh, hv, vh, vv`` with ``re`` and ``im`` each, from ``p`` 0 to 3; cells with all four, or (not ``whole``) all cells, with nulls for what they lack."""
    names = ("hh", "hv", "vh", "vv")
    one = lambda k, part: F.max(F.when(F.col("p") == k, F.col(part)))
    w = channels.groupBy("row", "col").agg(*(one(k, part).alias(n + part) for k, n in enumerate(names) for part in ("re", "im")))
    return w.dropna() if whole else w


def symmetrised(w: DataFrame) -> DataFrame:
    """The mean of both cross-polarised channels as one."""
    re, im = add(cplx.pair("hv"), cplx.pair("vh"))
    return w.select("row", "col", (re / 2).alias("re"), (im / 2).alias("im"))


def _circular(w: DataFrame) -> DataFrame:
    co, x = add(cplx.pair("hh"), cplx.pair("vv")), sub(cplx.pair("vh"), cplx.pair("hv"))
    turned = (-co[1], co[0])
    rl, lr = add(turned, x), sub(turned, x)
    re, im = conj_mul(lr, rl)
    return w.withColumns({"fre": re, "fim": im})


def faraday_bickel(w: DataFrame, keys: list[str]) -> DataFrame:
    """A quarter of the phase of the mean circular cross product."""
    return _circular(w).groupBy(*keys).agg((F.atan2(F.avg("fim"), F.avg("fre")) / 4).alias("angle"))


def faraday_freeman(w: DataFrame, keys: list[str]) -> DataFrame:
    """Half the arc tangent of the root of the power ratio; the sign is that of the mean real ratio."""
    co, x = add(cplx.pair("hh"), cplx.pair("vv")), sub(cplx.pair("vh"), cplx.pair("hv"))
    ratio = cplx.divide(x, co)[0]
    parts = w.groupBy(*keys).agg(F.avg(power(x)).alias("a"), F.avg(power(co)).alias("b"), F.signum(F.avg(ratio)).alias("s"))
    return parts.select(*keys, (F.col("s") * F.atan(F.sqrt(F.col("a") / F.nullif("b", F.lit(0.0)))) / 2).alias("angle"))


def channel_imbalance(w: DataFrame, keys: list[str]) -> DataFrame:
    """Amplitude and phase of HV over VH; a half turn is undone where HH correlates less with HV than against it."""
    re, im = conj_mul(cplx.pair("hv"), cplx.pair("vh"))
    with_hh = conj_mul(cplx.pair("hh"), cplx.pair("hv"))[0]
    g = w.groupBy(*keys).agg(F.avg(re).alias("x"), F.avg(im).alias("y"), F.avg(power(cplx.pair("hv"))).alias("p"), F.avg(power(cplx.pair("vh"))).alias("q"), F.avg(with_hh).alias("s"))
    return g.select(*keys, F.sqrt(F.col("p") / F.nullif("q", F.lit(0.0))).alias("amplitude"), F.atan2("y", "x").alias("phase"), F.when(F.col("s") < 0, -1).otherwise(1).alias("sign"))
