"""Least squares by sums of moments.

A group's sums are one aggregate with partial sums on every partition; only the small normal
equations, one row a group, go to numpy, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solve(df: DataFrame, keys: list[str], terms: list[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """``keys, n, k0, k1, ...``: coefficients of the terms for each group, NaN where the equations are singular."""
    w = F.lit(1.0) if weight is None else weight
    m = len(terms)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"a{i}_{j}") for i, j in pairs] + [F.sum(w * t * y).alias(f"b{i}") for i, t in enumerate(terms)]
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    kinds = ", ".join(f"`{k}` {t}" for k, t in g.dtypes if k in keys)
    out = [f"k{i}" for i in range(m)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            a, b = np.zeros((len(p), m, m)), p[[f"b{i}" for i in range(m)]].to_numpy(float)
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = p[f"a{i}_{j}"]
            x = np.full((len(p), m), np.nan)
            ok = np.isfinite(a).all(axis=(1, 2)) & (np.linalg.matrix_rank(np.nan_to_num(a)) == m)
            if ok.any():
                x[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            yield pd.concat([p[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(x, columns=out)], axis=1)

    return g.mapInPandas(run, f"{kinds}, n long, {', '.join(f'{k} double' for k in out)}")


def powers(x: Column, degree: int) -> list[Column]:
    return [F.lit(1.0), *(F.pow(x, F.lit(k)) for k in range(1, degree + 1))]


def plane_terms(u: Column, v: Column, degree: int) -> list[Column]:
    """1, u, v, and for degree 2 u u, u v, v v."""
    return [F.lit(1.0), u, v] + ([u * u, u * v, v * v] if degree > 1 else [])


def value(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for i, t in enumerate(terms):
        out = out + F.col(f"k{i}") * t
    return out


def without_ramp(cells: DataFrame, x: str, keys: list[str], degree: int = 1) -> DataFrame:
    """x less its least-squares plane (or quadratic) of row and column.

    Rows and columns are taken from their group's mean in units of their deviation: as they stand, the moments of a
    few lines far down an image are those of its line numbers, and the equations look singular.
    """
    with_row = lambda d, one: d.join(one, keys) if keys else d.crossJoin(F.broadcast(one))
    there = cells.where(F.col(x).isNotNull())
    scale = lambda k: F.coalesce(F.nullif(F.stddev_pop(k), F.lit(0.0)), F.lit(1.0))
    centre = there.groupBy(*keys).agg(*(f(k).alias(f"_{n}{k}") for k in ("row", "col") for n, f in (("m", F.avg), ("s", scale))))
    terms = plane_terms(*((F.col(k) - F.col(f"_m{k}")) / F.col(f"_s{k}") for k in ("row", "col")), degree)
    k = solve(with_row(there, centre), keys, terms, F.col(x)).drop("n")
    joined = with_row(with_row(cells, centre), k)
    return joined.withColumn(x, F.col(x) - value(terms)).drop(*(f"k{i}" for i in range(len(terms))), *(f"_{n}{k}" for k in ("row", "col") for n in "ms"))


def robust_surface(ties: DataFrame, keys: list[str], x: str, terms: list[Column], weight: Column, critical: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Surface fit with outliers taken out one a group and round: (kept rows with residuals, coefficients).

    Each round drops the row of the greatest weighted residual over its group's deviation, if
    that is more than the critical value; ``id`` breaks ties. A group without such a row is done.
    """
    from echogrid.shared import materialize

    k = None
    for _ in range(rounds + 1):
        k = materialize(solve(ties, keys, terms, F.col(x), weight), "surface")
        names = [f"k{i}" for i in range(len(terms))]
        r = ties.join(k, keys).withColumn("residual", F.col(x) - value(terms)).drop(*names)
        sd = F.sqrt(F.sum(weight * F.col("residual") ** 2) / F.nullif(F.max("n") - len(terms), F.lit(0)))
        g = r.groupBy(*keys).agg(sd.alias("sd"), F.max(F.struct(F.abs(F.sqrt(weight) * F.col("residual")).alias("w"), "id")).alias("worst"))
        bad = g.where((F.col("sd") > 0) & (F.col("worst.w") / F.col("sd") > critical)).select(*keys, F.col("worst.id").alias("id"))
        left = materialize(r.join(bad, [*keys, "id"], "left_anti").drop("residual", "n"), "ties")
        if left.count() == r.count():
            break
        ties = left
    final = ties.join(k, keys).withColumn("residual", F.col(x) - value(terms)).drop("n", *names)
    return final, k
