"""Block aggregates of rasters: multilooking, coherence, covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.functions import cplx


def extent(cells: DataFrame) -> tuple[int, int]:
    """Numbers of rows and columns of a raster that starts at 0, 0 (one aggregate)."""
    r = cells.agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("rows"), F.coalesce(F.max("col") + 1, F.lit(0)).alias("cols")).first()
    return r["rows"], r["cols"]


def multilook(cells: DataFrame, rows: int, cols: int, shape: tuple[int, int], keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates over blocks of ``rows`` by ``cols`` cells; blocks that the shape cuts off are dropped."""
    whole = (F.col("row") < shape[0] // rows * rows) & (F.col("col") < shape[1] // cols * cols)
    block = cells.where(whole).groupBy(*keys, F.floor(F.col("row") / rows).alias("row"), F.floor(F.col("col") / cols).alias("col"))
    return block.agg(*(x.alias(k) for k, x in aggregates.items()))


def weighted(x: Column, w: Column) -> Column:
    """Aggregate: the weighted mean, null if no weight."""
    return F.sum(w * x) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def valid(x: Column, nodata) -> Column:
    return F.when(x != nodata, x)


def power_mean(z: cplx.Pair, p: float) -> Column:
    """Aggregate: mean of the modulus to the power p."""
    return F.avg(F.pow(cplx.modulus(z), F.lit(p)))


def coherence(a: cplx.Pair, b: cplx.Pair, cells: int | None = None) -> Column:
    """Aggregate: modulus of the mean product over the root of the mean powers; 1 everywhere for looks of one cell."""
    if cells == 1:
        return F.lit(1.0)
    re, im = cplx.mean(cplx.conj_mul(a, b))
    return F.hypot(re, im) / F.nullif(F.sqrt(F.avg(cplx.power(a)) * F.avg(cplx.power(b))), F.lit(0.0))


def interferogram(reference: DataFrame, secondary: DataFrame) -> DataFrame:
    """``row, col, re, im, bre, bim, ire, iim``: both images and their product with the conjugate."""
    b = secondary.select("row", "col", F.col("re").alias("bre"), F.col("im").alias("bim"))
    both = reference.select("row", "col", "re", "im").join(b, ["row", "col"])
    re, im = cplx.conj_mul(cplx.pair(), cplx.pair("b"))
    return both.withColumns({"ire": re, "iim": im})


def covariance(channels: DataFrame, rows: int, cols: int, shape: tuple[int, int]) -> DataFrame:
    """``row, col, i, j, re, im``: mean products of all pairs of polarisations ``p``, i <= j.

    A cell's channels meet in one group, so no image is joined with itself.
    """
    cell = channels.groupBy("row", "col").agg(F.array_sort(F.collect_set(F.struct("p", "re", "im"))).alias("z"))
    product = lambda a, b: F.struct(a["p"].alias("i"), b["p"].alias("j"), (a["re"] * b["re"] + a["im"] * b["im"]).alias("pre"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("pim"))
    pairs = F.flatten(F.transform("z", lambda a: F.transform(F.filter("z", lambda b: b["p"] >= a["p"]), lambda b: product(a, b))))
    flat = cell.select("row", "col", F.inline(pairs))
    return multilook(flat, rows, cols, shape, ("i", "j"), re=F.avg("pre"), im=F.avg("pim"))
