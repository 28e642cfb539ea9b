"""Granule names and ISO times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GRANULE = r"^L(\d)_(\d{3})_([AD])_(\d{8}T\d{6})$"


def granule_id(level: int, track: Column, ascending: Column, start: Column) -> Column:
    return F.concat(F.lit(f"L{level}_"), F.lpad(track.cast("string"), 3, "0"), F.when(ascending, "_A_").otherwise("_D_"), F.date_format(start, "yyyyMMdd'T'HHmmss"))


def granule_parts(name: Column) -> dict[str, Column]:
    part = lambda k: F.regexp_extract(name, _GRANULE, k)
    return {"level": part(1).cast("int"), "track": part(2).cast("int"), "direction": part(3), "start": part(4)}


def iso_seconds(text: Column, epoch: int) -> Column:
    """Seconds after the epoch, the fraction of any length kept as a double."""
    whole = F.unix_timestamp(F.substring(text, 1, 19), "yyyy-MM-dd'T'HH:mm:ss") - epoch
    return whole + F.coalesce(F.concat(F.lit("0"), F.substring(text, 20, 30)).cast("double"), F.lit(0.0))
