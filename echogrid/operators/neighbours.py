"""Window and neighbourhood operators on dense rasters.

A two-dimensional window is two one-dimensional ones, along the lines and then along the
columns, so a k by k neighbourhood costs 2 k terms, not k * k rows a cell. Both run within blocks of
``BLOCK`` lines: a cell within reach of a block's edge is dealt to the neighbouring block as well,
the blocks are shuffled once, and what a block computed on its halo is dropped. So no window is
longer than a line or a block, however many lines an image has. ``keys``: columns that name the
image, where a table holds several.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from echogrid.functions import cplx
from echogrid.functions.radar import TAU
from echogrid.shared import materialize

#: Lines of a block.
BLOCK = 64
Keys = tuple[str, ...]


def blocked(cells: DataFrame, reach: int, keys: Keys = ()) -> DataFrame:
    """``cells`` with ``_b``, the block of lines; cells within ``reach`` lines of a block stand in it too. One shuffle by block."""
    at = lambda k: F.floor((F.col("row") + k) / BLOCK)
    return cells.withColumn("_b", F.explode(F.sequence(at(-reach), at(reach)))).repartition(*keys, "_b")


def owned(blocks: DataFrame) -> DataFrame:
    """The cells of the blocks without their halo."""
    return blocks.where(F.col("_b") == F.floor(F.col("row") / BLOCK)).drop("_b")


def along(keys: Keys = ()) -> WindowSpec:
    """A block's line by columns."""
    return Window.partitionBy(*keys, "_b", "row").orderBy("col")


def across(keys: Keys = ()) -> WindowSpec:
    """A block's column by lines."""
    return Window.partitionBy(*keys, "_b", "col").orderBy("row")


def _pass(x: str, kernel: list[float], w: WindowSpec) -> Column:
    """The kernel's weighted sum over the cells beside this one; cells beyond the edge count as 0."""
    half = len(kernel) // 2
    return reduce(lambda a, b: a + b, (F.coalesce(F.lead(x, j - half).over(w), F.lit(0.0)) * k for j, k in enumerate(kernel)))


def smooth(cells: DataFrame, values: list[str], rows: list[float], cols: list[float], weight: Column | None = None, keys: Keys = ()) -> DataFrame:
    """``values`` convolved with a separable kernel of odd lengths.

    Without a weight the sum is over the whole kernel's sum, edges included as zeros. With a
    weight (or mask) it is over the kernel weight that meets it: 0 where none does, and where
    a cell's own weight is 0 the cell stays as it is.
    """
    own = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    d = cells.withColumn("_w", own).withColumns({f"_{v}": F.coalesce(F.col(v), F.lit(0.0)) * F.col("_w") for v in values})
    parts = [f"_{v}" for v in values] + ([] if weight is None else ["_w"])
    d = blocked(d, len(rows) // 2, keys).withColumns({f"{p}a": _pass(p, cols, along(keys)) for p in parts})
    d = owned(d.withColumns({f"{p}b": _pass(f"{p}a", rows, across(keys)) for p in parts}))
    if weight is None:
        out = {v: F.col(f"_{v}b") / (sum(rows) * sum(cols)) for v in values}
    else:
        out = {v: F.when(F.col("_w") == 0, F.col(v)).when(F.col("_wb") == 0, 0.0).otherwise(F.col(f"_{v}b") / F.col("_wb")) for v in values}
    return d.withColumns(out).drop("_w", "_wa", "_wb", *(f"_{v}{s}" for v in values for s in ("", "a", "b")))


def smooth_with_sigma(cells: DataFrame, x: str, sigma: str, rows: list[float], cols: list[float], keys: Keys = ()) -> DataFrame:
    """Smoothing weighted by 1 / sigma squared, with the sigma of the result."""
    w = F.when(F.col(sigma) > 0, 1 / F.col(sigma) ** 2).otherwise(0.0)
    d = blocked(cells.withColumns({"_w": w, "_x": w * F.coalesce(F.col(x), F.lit(0.0))}), len(rows) // 2, keys)
    square = lambda k: [a * a for a in k]
    a, b = along(keys), across(keys)
    d = d.withColumns({"_wa": _pass("_w", cols, a), "_xa": _pass("_x", cols, a), "_sa": _pass("_w", square(cols), a)})
    d = owned(d.withColumns({"_wb": _pass("_wa", rows, b), "_xb": _pass("_xa", rows, b), "_sb": _pass("_sa", square(rows), b)}))
    total = F.nullif(F.col("_wb"), F.lit(0.0))
    return d.withColumns({x: F.col("_xb") / total, sigma: F.sqrt("_sb") / total}).drop(*(f"_{a}{b}" for a in "wxs" for b in ("", "a", "b")))


def _near(blocks: DataFrame, x: str, rows: int, cols: int, out: str, keys: Keys) -> DataFrame:
    d = blocks.withColumn("_a", F.collect_list(x).over(along(keys).rangeBetween(-cols, cols)))
    return d.withColumn(out, F.array_sort(F.flatten(F.collect_list("_a").over(across(keys).rangeBetween(-rows, rows))))).drop("_a")


def near(cells: DataFrame, x: str, rows: int, cols: int, out: str = "near", keys: Keys = ()) -> DataFrame:
    """``out``: all values that are not null within so many rows and columns, sorted."""
    return owned(_near(blocked(cells, rows, keys), x, rows, cols, out, keys))


def middle(a: Column) -> Column:
    """Median of a sorted array; null if empty."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def median(cells: DataFrame, x: str, rows: int, cols: int, out: str = "median", keys: Keys = ()) -> DataFrame:
    return near(cells, x, rows, cols, "_n", keys).withColumn(out, middle(F.col("_n"))).drop("_n")


def deviation(cells: DataFrame, x: str, rows: int, cols: int, keys: Keys = ()) -> DataFrame:
    """``median`` and ``mad``, the median of the distances of the neighbours from it."""
    d = near(cells, x, rows, cols, "_n", keys).withColumn("median", middle(F.col("_n")))
    return d.withColumn("mad", middle(F.array_sort(F.transform("_n", lambda v: F.abs(v - F.col("median")))))).drop("_n")


def count_near(cells: DataFrame, flag: Column, rows: int, cols: int, out: str, keys: Keys = ()) -> DataFrame:
    """How many cells within so many rows and columns have the flag."""
    d = blocked(cells.withColumn("_k", flag.cast("int")), rows, keys).withColumn("_f", F.sum("_k").over(along(keys).rangeBetween(-cols, cols)))
    return owned(d.withColumn(out, F.sum("_f").over(across(keys).rangeBetween(-rows, rows)))).drop("_f", "_k")


def fill_mean(cells: DataFrame, x: str, rows: int, cols: int, rounds: int = 1, keys: Keys = ()) -> DataFrame:
    """Null cells get the mean of their neighbours, in so many rounds (all within one shuffle: the halo holds them)."""
    a, b = along(keys).rangeBetween(-cols, cols), across(keys).rangeBetween(-rows, rows)
    d = blocked(cells, rows * rounds, keys)
    for _ in range(rounds):
        d = d.withColumns({"_s": F.sum(x).over(a), "_n": F.count(x).over(a)}).withColumns({"_t": F.sum("_s").over(b), "_m": F.sum("_n").over(b)})
        d = d.withColumn(x, F.coalesce(x, F.col("_t") / F.nullif(F.col("_m"), F.lit(0)))).drop("_s", "_n", "_t", "_m")
    return owned(d)


def fill_from(cells: DataFrame, x: str, other: DataFrame, y: str, rows: int, cols: int, keys: Keys = ()) -> DataFrame:
    """Null cells get the mean of another layer's cells around them; null where it has none there either."""
    at = [*keys, "row", "col"]
    d = cells.join(other.select(*at, F.col(y).alias("_y")), at, "left")
    a, b = along(keys).rangeBetween(-cols, cols), across(keys).rangeBetween(-rows, rows)
    d = blocked(d, rows, keys).withColumns({"_s": F.sum("_y").over(a), "_n": F.count("_y").over(a)})
    d = owned(d.withColumns({"_t": F.sum("_s").over(b), "_m": F.sum("_n").over(b)}))
    return d.withColumn(x, F.coalesce(x, F.col("_t") / F.nullif(F.col("_m"), F.lit(0)))).drop("_y", "_s", "_n", "_t", "_m")


def fill_pyramid(cells: DataFrame, x: str, layers: list[str], rows: int, cols: int, keys: Keys = (), rounds: int = 4) -> DataFrame:
    """Holes of the finest layer ``x`` filled from the coarser ``layers`` (columns, finer ones first), then from their own edges inward.

    A layer fills what those before it left, by the mean of its cells around a hole. What no layer
    reaches is filled in rounds from its neighbours, ``rounds`` of them a shuffle, until an image has no hole
    or no value at all; the cells of each pass are written to the shared folder.
    """
    d = cells
    for y in layers:
        d = fill_from(d, x, cells, y, rows, cols, keys)
    d = materialize(d, "pyramid")
    left = None
    while True:
        now = d.where(F.col(x).isNull()).count()
        if now in (0, left):
            return d
        left, d = now, materialize(fill_mean(d, x, rows, cols, rounds, keys), "pyramid")


def fill_lines(cells: DataFrame, x: str, keys: Keys = ()) -> DataFrame:
    """Null cells between others of their line by a straight line, those at the ends by the nearest."""
    back = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col(x).isNotNull(), F.struct(F.col("col").alias("c"), F.col(x).alias("v")))
    d = cells.withColumns({"_b": F.last(own, True).over(back), "_a": F.first(own, True).over(ahead)})
    b, a = F.col("_b"), F.col("_a")
    share = (F.col("col") - b["c"]) / (a["c"] - b["c"])
    return d.withColumn(x, F.coalesce(x, b["v"] + (a["v"] - b["v"]) * share, b["v"], a["v"])).drop("_b", "_a")


def residues(cells: DataFrame, phase: str, keys: Keys = ()) -> DataFrame:
    """``charge``: whole turns around each 2 by 2 loop; 0 in the last row and column."""
    d = blocked(cells, 1, keys).withColumns({"_r": F.lead(phase).over(along(keys)), "_b1": F.lead(phase).over(across(keys))})
    d = owned(d.withColumn("_d", F.lead("_r").over(across(keys))))
    turn = lambda a, b: F.round((a - b) / TAU)
    p = F.col(phase)
    loop = turn(F.col("_b1"), p) + turn(F.col("_d"), F.col("_b1")) + turn(F.col("_r"), F.col("_d")) + turn(p, F.col("_r"))
    return d.withColumn("charge", F.coalesce(loop, F.lit(0.0)).cast("int")).drop("_r", "_b1", "_d")


def phase_gradient(cells: DataFrame, rows: list[float], cols: list[float], keys: Keys = ()) -> DataFrame:
    """``gx, gy``: phase of the smoothed product of each cell with the one left of it and above it."""
    d = blocked(cells, 1, keys)
    for name, w in (("x", along(keys)), ("y", across(keys))):
        re, im = cplx.conj_mul(cplx.pair(), (F.lag("re").over(w), F.lag("im").over(w)))
        d = d.withColumns({f"{name}re": F.coalesce(re, F.lit(0.0)), f"{name}im": F.coalesce(im, F.lit(0.0))})
    d = smooth(owned(d), ["xre", "xim", "yre", "yim"], rows, cols, keys=keys)
    return d.withColumns({"gx": F.atan2("xim", "xre"), "gy": F.atan2("yim", "yre")}).drop("xre", "xim", "yre", "yim")


def eroded(cells: DataFrame, flag: Column, rows: int, cols: int, out: str = "eroded", keys: Keys = ()) -> DataFrame:
    """Whether all cells of the neighbourhood exist and have the flag."""
    return count_near(cells, flag, rows, cols, "_c", keys).withColumn(out, F.col("_c") == (2 * rows + 1) * (2 * cols + 1)).drop("_c")


def opened(cells: DataFrame, flag: Column, out: str = "opened", keys: Keys = ()) -> DataFrame:
    """Opening with a 3 by 3 cross: erosion, where what is beyond the edge is unset, then dilation."""

    def cross(x: str, test) -> Column:
        return reduce(test, (F.col(x), *(F.coalesce(F.lag(x, k).over(w), F.lit(False)) for k in (1, -1) for w in (along(keys), across(keys)))))

    d = blocked(cells.withColumn("_f", flag), 2, keys)
    d = d.withColumn("_e", cross("_f", lambda a, b: a & b))
    return owned(d.withColumn(out, cross("_e", lambda a, b: a | b))).drop("_f", "_e")


def repair_turns(cells: DataFrame, x: str, rows: int, cols: int, rounds: int, keys: Keys = ()) -> DataFrame:
    """Whole turns by which cells miss the median around them are taken off, in rounds."""
    d = blocked(cells, rows * rounds, keys)
    for _ in range(rounds):
        m = _near(d, x, rows, cols, "_n", keys)
        d = m.withColumn(x, F.col(x) - TAU * F.rint((F.col(x) - middle(F.col("_n"))) / TAU)).drop("_n")
    return owned(d)


def repair_turns_smoothed(cells: DataFrame, x: str, rows: list[float], cols: list[float], rounds: int, keys: Keys = ()) -> DataFrame:
    """Whole turns by which cells miss the smoothed surface around them are taken off, in rounds.

    Cells of zero, and null ones, are holes: they stay as they are and do not count in the
    surface, whose kernel is renewed by what it meets. All rounds are within one shuffle: the halo holds them.
    """
    a, b = along(keys), across(keys)
    d = blocked(cells.withColumn("_x", F.nullif(F.col(x), F.lit(0.0))), len(rows) // 2 * rounds, keys)
    for _ in range(rounds):
        d = d.withColumns({"_n": F.coalesce("_x", F.lit(0.0)), "_d": F.col("_x").isNotNull().cast("double")})
        d = d.withColumns({f"{k}a": _pass(k, cols, a) for k in ("_n", "_d")})
        d = d.withColumns({f"{k}b": _pass(f"{k}a", rows, b) for k in ("_n", "_d")})
        d = d.withColumn("_x", F.col("_x") - TAU * F.rint((F.col("_x") - F.col("_nb") / F.nullif(F.col("_db"), F.lit(0.0))) / TAU))
    return owned(d).withColumn(x, F.coalesce("_x", x)).drop("_x", *(f"{k}{s}" for k in ("_n", "_d") for s in ("", "a", "b")))


def layover_shadow(cells: DataFrame, keys: list[str], order: str, angle: str, reach: str, slack: float = 0.0) -> DataFrame:
    """``code``: 1 where the angle stays below the greatest before it, 2 where the reach does not grow from either end; or-ed."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    shadow = F.coalesce(F.col(angle) <= F.max(angle).over(before) - slack, F.lit(False))
    layover = F.coalesce(F.col(reach) <= F.max(reach).over(before), F.lit(False)) | F.coalesce(F.col(reach) >= F.min(reach).over(after), F.lit(False))
    return cells.withColumn("code", F.when(shadow, 1).otherwise(0).bitwiseOR(F.when(layover, 2).otherwise(0)))


def quadratic_peak(a: Column, b: Column, c: Column) -> Column:
    """Place of the vertex of a parabola through values at -1, 0 and 1."""
    return (a - c) / F.nullif(2 * (a - 2 * b + c), F.lit(0.0))


def quadratic_top(value) -> tuple[Column, Column, Column]:
    """``dy, dx, top`` of the quadratic surface that fits nine cells best; ``value(dy, dx)`` gives them, -1 to 1. Null where it is flat or a saddle."""
    nine = {(y, x): value(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)}
    total = lambda f: reduce(lambda a, b: a + b, (v * f(y, x) for (y, x), v in nine.items() if f(y, x)))
    every = total(lambda y, x: 1.0)
    by, bx, mixed = total(lambda y, x: y / 6), total(lambda y, x: x / 6), total(lambda y, x: x * y / 4)
    byy, bxx = total(lambda y, x: y * y / 2) - every / 3, total(lambda y, x: x * x / 2) - every / 3
    middle = (5 * every - 3 * total(lambda y, x: float(y * y + x * x))) / 9
    bend = 4 * byy * bxx - mixed * mixed
    good = (bend > 0) & (byy < 0)
    dy, dx = (mixed * bx - 2 * bxx * by) / bend, (mixed * by - 2 * byy * bx) / bend
    top = middle + (by * dy + bx * dx) / 2
    return tuple(F.when(good, v) for v in (dy, dx, top))


def masked_phase(cells: DataFrame, x: str, masked: Column | None = None, coherence: Column | None = None, least: float = 0.0, deviations: float | None = None, reach: int = 1, fill: str = "zero", keys: Keys = ()) -> DataFrame:
    """``cells`` with x as it goes to an unwrapper, and ``valid``: what a mask, a low coherence or the neighbours rule out is filled.

    A cell is ruled out by ``masked``, by a ``coherence`` below ``least``, or where it is more than ``deviations`` median absolute
    deviations from the median around it; no value is ruled out too. ``fill``: with "zero", or "mean", the mean of the
    valid cells around (0 where there is none).
    """
    d = cells.withColumn("_k", F.coalesce(masked, F.lit(False)) if masked is not None else F.lit(False))
    if coherence is not None:
        d = d.withColumn("_k", F.col("_k") | F.coalesce(coherence < least, F.lit(True)))
    if deviations is not None:
        d = deviation(d, x, reach, reach, keys)
        d = d.withColumn("_k", F.col("_k") | F.coalesce(F.abs(F.col(x) - F.col("median")) > deviations * F.col("mad"), F.lit(False))).drop("median", "mad")
    d = d.withColumn("valid", ~F.col("_k") & F.col(x).isNotNull()).withColumn(x, F.when(F.col("valid"), F.col(x))).drop("_k")
    if fill == "mean":
        d = fill_mean(d, x, reach, reach, keys=keys)
    return d.withColumn(x, F.coalesce(x, F.lit(0.0)))


def culled(cells: DataFrame, x: str, snr: Column | None = None, least: float = 0.0, variance: Column | None = None, most: float = 0.0, median_off: float | None = None, reach: int = 1, keys: Keys = ()) -> DataFrame:
    """``cells`` with x null where its signal is too weak, its variance too great, or it is too far from the median around it."""
    d = cells if median_off is None else median(cells, x, reach, reach, "_m", keys)
    bad = F.lit(False)
    if snr is not None:
        bad = bad | F.coalesce(snr < least, F.lit(True))
    if variance is not None:
        bad = bad | F.coalesce(variance > most, F.lit(True))
    if median_off is not None:
        bad = bad | (F.abs(F.col(x) - F.col("_m")) > median_off)
    return d.withColumn(x, F.when(~F.coalesce(bad, F.lit(True)), F.col(x))).drop("_m")

