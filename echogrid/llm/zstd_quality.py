"""Quality by compression with zstandard dictionaries (operator 5).

Two dictionaries are built, from good and from bad labelled texts. A whole text is compressed
with each, slice by slice; the difference of the two sizes, less what the dictionaries differ by
on any text (a number of bytes a byte), over the text's length and ``SMOOTH`` is the one input of
a logistic curve, fitted on other labelled texts. At no difference, so for a text too short to
tell, the curve gives the share of good labels.

Bounds: at most ``SAMPLE`` labelled documents of each class are learnt from, chosen by the hash
of their ids. Half of them give the dictionaries: their whole texts are cut into slices, and
the slices of least hash, from wherever in a text, fill ``DICTIONARY`` bytes of a class. The other
half gives the curve; their differences over whole texts are worked out on the executors, so the
driver gets one number a row. Every document is scored over its whole text.

Rows: null and empty texts have no difference and score like any other. Labels of unknown
documents, null ids and null labels are not used; of an id with contradictory labels the larger
counts, of an id with several texts the least one is learnt from. Repeated rows are scored row by
row, equal texts alike. If a class has no rows for the dictionaries or the curve (fewer than two),
the score is the share of good labels, or a half without labels. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, crc_mod, id_text, map_slices
from echogrid.llm.toxicity_gbt import sample
from echogrid.shared import materialize

SAMPLE, DICTIONARY, LEVEL = 2000, 1 << 20, 6
HELD_OUT, MOD, THRESHOLD = 0, 5, 0.3
#: Bytes added to a text's length, so that very short texts are near no difference.
SMOOTH = 64
#: A text is compressed in slices of so many bytes, so that a long one still meets the dictionaries and not only itself.
SLICE = 4096


class Model:
    """The dictionaries and the curve: log-odds of ``prior + slope * normalised difference``."""

    def __init__(self, good: bytes, bad: bytes, slope: float, bias: float, prior: float):
        self.good, self.bad, self.slope, self.bias, self.prior = good, bad, slope, bias, prior

    def sizes(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from texts to rows of the sizes' difference and the length, both over the smoothed length."""
        pack = []
        for raw in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if raw:
                d.precompute_compress(level=LEVEL)
            pack.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        size = lambda p, t: sum(len(p.compress(t[k : k + SLICE])) for k in range(0, len(t), SLICE))
        return lambda texts: np.array([((size(pack[0], t) - size(pack[1], t)) / (len(t) + SMOOTH), len(t) / (len(t) + SMOOTH)) for t in texts], float).reshape(-1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + self.slope * (x[:, 0] - self.bias * x[:, 1]), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Slope, bias and prior: a weighted logistic curve that goes through the labels' share, by Newton steps with a light ridge."""
    prior = float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    scale = np.array([float(np.std(x[:, 0])) or 1.0, 1.0])
    design, k, w = x / scale, np.zeros(2), weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(prior + design @ k, -40, 40)))
        step = np.linalg.solve((design.T * (w * p * (1 - p))) @ design + 1e-2 * np.eye(2), design.T @ (w * (y - p)) - 1e-2 * k)
        k += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope, level = (k / scale).tolist()
    return slope, -level / slope if slope else 0.0, prior


def dictionaries(rows: DataFrame) -> dict[int, bytes]:
    """Of each class the slices of least hash of its whole texts, ``DICTIONARY`` bytes at most, the least last (nearest to what is compressed)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [(i, y, k, t[k : k + SLICE]) for i, y, t in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), byte_texts(batch), strict=True) for k in range(0, len(t), SLICE)]
            return pa.RecordBatch.from_arrays([pa.array([c[j] for c in cut], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], list("abcd"))

        return each

    ranked = map_slices(rows.select("doc_id", "text", "y"), make, "doc_id long, y int, at long, slice binary").withColumn("rank", F.xxhash64("doc_id", "at"))
    out = {}
    for y in (0, 1):
        # Enough slices even if most are the short ends of texts; what is over the bound is cut by whole slices.
        some = sorted(ranked.where(F.col("y") == y).orderBy("rank", "doc_id", "at").limit(8 * DICTIONARY // SLICE).select("rank", "doc_id", "at", "slice").toLocalIterator(prefetchPartitions=False))
        sizes = np.cumsum([len(r.slice) + 1 for r in some])
        out[y] = b"\n".join(bytes(r.slice) for r in reversed(some[: int(np.searchsorted(sizes, DICTIONARY, "right"))]))
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    rows = materialize(sample(docs, labels, "quality", HELD_OUT, MOD, SAMPLE), "quality-sample")
    sizes = {(r.y, r.fold): r["count"] for r in rows.groupBy("y", (F.col("part") % 2).alias("fold")).count().collect()}
    if not all((y, fold) in sizes for y in (0, 1) for fold in (0, 1)):
        share = (sum(v for (y, _), v in sizes.items() if y == 1) + 0.5) / (sum(sizes.values()) + 1)
        return Model(b"", b"", 0.0, 0.0, float(np.log(share / (1 - share))))
    raw = dictionaries(rows.where("part % 2 = 0"))
    shared = spark.sparkContext.broadcast(Model(raw[1], raw[0], 0.0, 0.0, 0.0))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        sizes = shared.value.sizes()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = sizes(byte_texts(batch))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("weight"), pa.array(x[:, 0]), pa.array(x[:, 1])], list("abcde"))

        return each

    found = sorted(map_slices(rows.where("part % 2 = 1").select("doc_id", "text", "y", "weight"), make, "doc_id long, y int, weight double, x double, size double").collect())
    # Each class is sampled on its own; a row counts for as many labels as it stands for.
    return Model(raw[1], raw[0], *fit(np.array([(r.x, r.size) for r in found]), np.array([r.y for r in found], float), np.array([r.weight for r in found])))


def scorer(model: Model, spark) -> Callable:
    """A column function: score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        sizes = own.sizes()
        for part in parts:
            yield pd.Series(own.score(sizes([(t or "").encode() for t in part])))

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``."""
    score = scorer(learn(docs, labels), docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), MOD) == HELD_OUT, F.lit(False))
    scored = id_text(docs).select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored as bad; all columns stay."""
    score = scorer(learn(docs, labels), docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)
