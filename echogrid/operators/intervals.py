"""Interval and run operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subswath(cells: DataFrame, swaths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` with ``s``: the first sub-swath whose valid interval ``[start, stop)`` of the line holds the cell, 0 if none.

    A line's intervals are gathered into one short array first, so each cell meets one row. A
    sub-swath without any intervals is a row of ``s`` with a null ``row``: all cells belong to it.
    Without any sub-swath at all (of the image named by ``keys``) every cell belongs to 1.
    """
    lines = swaths.where(F.col("row").isNotNull()).groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("s", "start", "stop"))).alias("own"))
    known = swaths.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.when(F.col("row").isNull(), F.col("s"))).alias("_all"))
    inside = F.filter("own", lambda i: (F.col("col") >= i["start"]) & (F.col("col") < i["stop"]))
    d = cells.join(lines, [*keys, "row"], "left")
    # One row an image: a plain one-row side without keys.
    d = d.join(known, list(keys), "left") if keys else d.crossJoin(F.broadcast(known))
    first = F.least(F.get(inside, F.lit(0))["s"], F.col("_all"))
    return d.withColumn("s", F.coalesce(first, F.when(F.coalesce("_n", F.lit(0)) == 0, 1).otherwise(0))).drop("own", "_n", "_all")


def fill_gaps(cells: DataFrame, swaths: DataFrame, value: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells outside all valid intervals get the given values."""
    named = subswath(cells, swaths, keys)
    return named.withColumns({k: F.when(F.col("s") > 0, F.col(k)).otherwise(v) for k, v in value.items()}).drop("s")


def overlaps(windows: DataFrame, pulses: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Pairs of receive windows ``i, start, stop`` and pulses ``j, t`` with ``start <= t <= stop``.

    Both are dealt to time buckets: a window to all it touches, a pulse to its own; then an equi-join.
    """
    first, last = (F.floor(F.col(x) / bucket) for x in ("start", "stop"))
    w = windows.withColumn("bucket", F.explode(F.sequence(first, last)))
    p = pulses.withColumn("bucket", F.floor(F.col("t") / bucket))
    return w.join(p, [*keys, "bucket"]).where(F.col("t").between(F.col("start"), F.col("stop"))).drop("bucket")


def channel_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Bands of ``a`` cut to those of ``b`` of the same polarisation; those of no width are dropped."""
    low = lambda d: F.col(f"{d}.center") - F.col(f"{d}.width") / 2
    high = lambda d: F.col(f"{d}.center") + F.col(f"{d}.width") / 2
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "pol")]
    both = a.alias("a").join(b.alias("b"), on).where((low("a") <= high("b")) & (low("b") <= high("a")))
    lo, hi = F.greatest(low("a"), low("b")), F.least(high("a"), high("b"))
    return both.select(*(F.col(f"a.{k}").alias(k) for k in (*keys, "pol")), F.col("a.id").alias("id"), F.col("a.freq").alias("freq"), F.col("b.id").alias("other"), ((lo + hi) / 2).alias("center"), (hi - lo).alias("width")).where("width > 0")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """``keys, first, last``: maximal runs of consecutive ``order`` numbers where the flag holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = df.where(flag).withColumn("_g", F.col(order) - F.row_number().over(w))
    return kept.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_g")


def changes(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first row of each group and all rows whose values differ from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    before = F.lag(now).over(w)
    return df.withColumn("_c", before.isNull() | ~before.eqNullSafe(now)).where("_c").drop("_c")


def flagged(cells: DataFrame, intervals: DataFrame, x: str) -> DataFrame:
    """``cells`` with ``bits``: the or of the bits of all given intervals that hold x; ``intervals``: a short list, gathered in one row."""
    own = intervals.agg(F.collect_list(F.struct("low", "high", "bit")).alias("own"))
    held = F.filter("own", lambda i: F.col(x).between(i["low"], i["high"]))
    return cells.crossJoin(F.broadcast(own)).withColumn("bits", F.aggregate(held, F.lit(0), lambda a, i: a.bitwiseOR(F.pow(F.lit(2.0), i["bit"]).cast("int")))).drop("own")
