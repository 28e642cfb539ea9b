"""Readers of state vectors, electron content and surveys, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per element of the tag: orbit state vectors, pointing vectors."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)


def parallel_json(spark: SparkSession, path: str, columns: dict[str, str], keys: str) -> DataFrame:
    """Files with parallel arrays to one row per place in them."""
    schema = ", ".join([keys, *(f"{k} array<{t}>" for k, t in columns.items())])
    names = [k.split()[0] for k in keys.split(", ")]
    d = spark.read.schema(schema).json(path)
    return d.select(*names, F.inline(F.arrays_zip(*columns)))


def csv(spark: SparkSession, path: str, schema: str, degrees: list[str] | None = None) -> DataFrame:
    """A survey with a header and ``#`` comments; columns in degrees come in radians."""
    d = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    return d.withColumns({k: F.radians(k) for k in degrees or []})


def states(spark: SparkSession, path: str, tag: str, schema: str, utc: str = "utc", epoch: float = 0.0) -> DataFrame:
    """State vectors of an XML file with ``t``: seconds since the epoch (in Unix seconds) of their UTC strings."""
    seconds = F.unix_micros(F.to_timestamp(F.concat(utc, F.lit("Z")))) / 1000000.0 - epoch
    return xml(spark, path, tag, schema).withColumn("t", seconds)
