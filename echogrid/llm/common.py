"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null gives empty bytes."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice but a single row holds more than ``most_bytes`` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, most_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` with a function made once per task and text slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in slices(batches, most_bytes):
            out = each(part)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
