"""Raster tables: cells, lines, bands and their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_lines(cells: DataFrame, values: list[str], keys: tuple[str, ...] = ("row",)) -> DataFrame:
    """One row per line, each value an array in the order of the columns."""
    g = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", *values))).alias("_s"))
    return g.select(*keys, *(F.col(f"_s.{v}").alias(v) for v in values))


def as_cells(lines: DataFrame, values: list[str], keys: tuple[str, ...] = ("row",)) -> DataFrame:
    return lines.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("col", "_s")).select(*keys, "col", *(F.col("_s")[v].alias(v) for v in values))


def window(lines: DataFrame, values: list[str], rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of a window of a line table; only its lines are read and only its columns unpacked."""
    n = cols[1] - cols[0] + 1
    cut = lines.where(F.col("row").between(*rows)).select("row", *(F.slice(v, cols[0] + 1, n).alias(v) for v in values))
    return as_cells(cut, values).withColumn("col", F.col("col") + cols[0])


def stack(bands: list[DataFrame]) -> DataFrame:
    """Rasters as bands 1, 2, ... of one."""
    return reduce(DataFrame.unionByName, (b.withColumn("band", F.lit(k)) for k, b in enumerate(bands, 1)))


def wide(stacked: DataFrame, bands: int) -> DataFrame:
    return stacked.groupBy("row", "col").pivot("band", list(range(1, bands + 1))).agg(F.first("v")).select("row", "col", *(F.col(str(k)).alias(f"b{k}") for k in range(1, bands + 1)))


def channels(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows of the wanted polarisations of each frequency."""
    return df.where(reduce(lambda a, b: a | b, ((F.col("freq") == f) & F.col("pol").isin(p) for f, p in wanted.items())))


def write(cells: DataFrame, path: str, axis: dict[str, float], raster_id: str = "raster_id") -> None:
    """Write a raster by id, lines of a block together, and its axes beside it."""
    blocks = F.floor(F.col("row") / 256)
    cells.repartition(raster_id, blocks).sortWithinPartitions(raster_id, "row", "col").write.partitionBy(raster_id).parquet(f"{path}/cells")
    names = sorted(axis)
    cells.sparkSession.createDataFrame([tuple(float(axis[k]) for k in names)], ", ".join(f"{k} double" for k in names)).write.parquet(f"{path}/axis")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/axis").first().asDict()


def append_stats(cells: DataFrame, path: str, layer: str, keys: tuple[str, ...] = ("raster_id",)) -> None:
    """Append the statistics of a layer to a table beside the product."""
    from echogrid.operators.stats import real_stats

    cells.groupBy(*keys).agg(*real_stats(F.col("v"))).withColumn("layer", F.lit(layer)).write.mode("append").parquet(path)
